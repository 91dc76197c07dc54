"""The ten operators against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import chat, licenses, mixing, neardup, pieces, quality, queries, sharding, simhash, substring, toxicity

RNG = random.Random(5)
VOCAB = [a + b for a in ("ba", "ko", "ri", "te", "lu", "sha", "mo") for b in ("n", "rt", "sel", "dom", "pig", "ver")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empties, repeated ids and a long text."""
    texts = [prose(RNG.randrange(5, 140)) for _ in range(40)]
    for i in range(6):  # near copies: one or a few words changed
        words = texts[i].split()
        for k in range(1 + i % 3):
            words[(7 * k + 3) % len(words)] = "changed"
        texts.append(" ".join(words))
    passage = prose(60)
    texts += [f"{prose(20)} {passage}\n{prose(10)}", f"{passage} {prose(30)}", texts[0], texts[0].upper(), None, None, "", "  \n\t", "one", "ONE", "a b c", prose(3000), "x " * 200, "é ü 語 " * 12]
    rows = [(i, t, RNG.choice(["en", "fr", None]), "s", None) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[4], "de", "s", None), (None, "nobody", "de", "s", None), (7, "another text under a known id", "es", "s", None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, DOCS)
    return d.withColumn("key", F.lit(1)).withColumn("n", F.lit("clash")).withColumn("rk", F.lit(2)).withColumn("component_id", F.lit("c"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sharding(docs, none):
    got = sharding.lpt_shards(docs, 8).collect()
    assert len(got) == len(ROWS) and sharding.lpt_shards(none, 8).count() == 0
    slots, home = defaultdict(list), defaultdict(set)
    size = Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
    for r in got:
        home[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(v) == 1 for k, v in home.items() if k[1] > 1)
    largest = max(len((t or "").encode()) + 1 for _, t, *_ in ROWS)
    assert max(size.values()) <= max(sum(size.values()) / 8 + largest, largest)


def shingle_set(text, k):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_components(rows, k):
    sets = [shingle_set(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, none, k):
    sets, root = near_components(ROWS, k)
    ids = defaultdict(list)
    for (i, *_), r in zip(ROWS, root, strict=True):
        ids[r] += [i] if i is not None else []
    want = Counter()
    for (i, *_), s, r in zip(ROWS, sets, root, strict=True):
        c = (min(ids[r]) if ids[r] else None) if s else i
        want[i, len(s), c, None if c is None or i is None else i == c] += 1
    got = Counter(tuple(r) for r in neardup.near_duplicates(docs, k, 80).collect())
    assert got == want
    assert neardup.near_duplicates(none, k, 80).count() == 0


def crowd(n, shared, rng):
    """Texts that share a passage, of which each has ``shared`` in a hundred words."""
    passage = prose(shared, rng)
    return [f"{passage} {prose(100 - shared, rng)}" for _ in range(n)]


def edits(n, words, rng):
    base = prose(words, rng).split()
    out = [" ".join(base)]
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), 1 + i % 3):
            w[k] = f"edit{i}"
        out.append(" ".join(w))
    return out


def least_ids(texts, k):
    _, root = near_components(list(enumerate(texts)), k)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    return {i: least[r] for i, r in enumerate(root)}


@pytest.mark.parametrize("block", [4, 8, 256])
def test_hot_buckets_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(12)
    texts = [*edits(60, 60, rng), *edits(30, 60, rng), *crowd(40, 60, rng), *crowd(30, 80, rng), *crowd(12, 90, rng)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 4, 80).collect()}
    assert got == least_ids(texts, 4)


def test_cells_are_the_same_formed_at_once_or_key_by_key(monkeypatch):
    second = np.random.default_rng(1).integers(0, 9, (200, 16)).astype(np.uint64)
    second[:, 3:] += np.arange(200, dtype=np.uint64)[:, None] * np.uint64(100)
    whole = neardup._cells(second)
    monkeypatch.setattr(neardup, "FEW", 200)
    at_once = neardup._cells(second)
    np.fill_diagonal(whole, True)
    assert (whole == at_once).all() and not whole.all()


def test_rows_of_a_hot_bucket_grow_in_proportion(spark, monkeypatch):
    """Texts that are not linked share a bucket; no step makes a row for each pair of them."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = Counter()

    def staged(df, what, f=neardup.staged):
        out = f(df, what)
        rows[n, what] += out.count()
        return out

    monkeypatch.setattr(neardup, "staged", staged)
    for n in (150, 600):
        d = spark.createDataFrame([(i, t) for i, t in enumerate(crowd(n, 35, random.Random(3)))], "doc_id long, text string")
        assert neardup.near_duplicates(d, 4, 80).where("kept").count() == n
    assert rows[600, "minhash-hot"] > 600 and all(got <= 100 * n for (n, _), got in rows.items()), rows  # texts of a hundred shingles


@pytest.mark.parametrize("crowd", [12, 1024])
def test_near_copies_of_a_text_meet_once(spark, monkeypatch, crowd):
    """Copies with so many edits that most are not linked hold most shingles in common, but don't meet by each of them."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "CROWD", crowd)
    rows = Counter()

    def staged(df, what, f=neardup.staged):
        out = f(df, what)
        rows[what] += out.count()
        return out

    monkeypatch.setattr(neardup, "staged", staged)
    rng = random.Random(21)
    base, texts = prose(120, rng).split(), []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 10)):
            w[k] = f"edit{i}"
        texts.append(" ".join(w))
        if i % 30 == 0:  # linked with this copy, not with the text that all come from
            w[rng.randrange(120)] = "again"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 80).collect()}
    assert got == least_ids(texts, 4) and len(set(got.values())) > 20
    assert rows["minhash-family-labels"] > 100 and rows["minhash-buckets"] + rows["minhash-undecided"] < 20 * len(texts), rows


@pytest.mark.parametrize("paired, columns", [(1, 3), (2, 64), (16, 1024)])
def test_shingles_in_common_are_counted(monkeypatch, paired, columns):
    monkeypatch.setattr(neardup, "PAIRED", paired)
    monkeypatch.setattr(neardup, "COLUMNS", columns)
    rng = np.random.default_rng(8)
    base = np.arange(60, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(60, 90, 5).astype(np.uint64)]) for _ in range(40)]
    one, two = np.arange(0, 40, 3), np.arange(1, 40, 2)
    want = [[len(np.intersect1d(sets[a], sets[b])) for b in two] for a in one]
    got = neardup._in_common(sets, one, two)
    differ = one[:, None] != two[None, :]  # a set is not compared with itself
    assert (got == np.array(want))[differ].all()
    apart = [np.arange(10 * k, 10 * k + 9, dtype=np.uint64) for k in range(4)]
    assert (neardup._in_common(apart, np.arange(2), np.arange(2, 4)) == 0).all()


def test_deduplicated(docs, none):
    sets, root = near_components(ROWS, 5)
    got = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(docs).collect()]
    kept = Counter(r for (i, t, *_), r, s in {(x[:2], r, s): (x, r, s) for x, r, s in zip(ROWS, root, sets, strict=True)}.values() if (i, t) in got and s)
    assert set(kept) == {r for r, s in zip(root, sets, strict=True) if s} and max(kept.values()) == 1
    assert {(i, t) for i, t, *_ in ROWS if not words_of(t)} <= set(got) and neardup.deduplicated(none).count() == 0


def test_toxicity_learns_and_finds_passages(spark, none):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = prose(rng.randrange(30, 200), rng)
        if bad:
            w = text.split()
            at = rng.randrange(len(w))
            text = " ".join([*w[:at], *[rng.choice(["vile", "scum", "wretch", "filth"]) for _ in range(6)], *w[at:]])
        rows.append((i, text, "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(None, None, None, None, None), (9999, "", None, None, None)]
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab.where("doc_id % 3 <> 1"))
    out = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    assert sum((out[i]["score"] >= 0.7) == (i % 4 == 0) for i in held) / len(held) > 0.98
    hit = next(i for i in held if i % 4 == 0)
    p = out[hit]["passages"][0]
    assert set(toxicity.tokens_of(rows[hit][1])[p["start"] : p["end"]]) & {"vile", "scum", "wretch", "filth"}
    assert 0 <= out[None]["score"] <= 0.5 and out[None]["passages"] == [] and out[9999]["score"] == out[None]["score"]
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(d, toxicity.fit(none, lab)).count() == len(rows)


def maximal_segments(scores):
    """All maximal segments by their definition: the best segment (the shortest of equal ones), then those on both sides."""
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    i = -best[2]
    j = i - best[1]
    return [*maximal_segments(scores[:i]), (i, j, best[0]), *((a + j, b + j, s) for a, b, s in maximal_segments(scores[j:]))]


def test_segments_are_all_maximal():
    rng = random.Random(3)
    for _ in range(300):
        lexicon = {"a": rng.uniform(0.1, 3), "b": rng.uniform(-3, -0.1), "c": rng.uniform(0.1, 2)}
        tokens = [rng.choice("abcd") for _ in range(rng.randrange(1, 25))]
        got = toxicity.segments(tokens, lexicon, 0.251)
        want = maximal_segments([lexicon.get(t, -0.251) for t in tokens])
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_segments_take_linear_time():
    tokens = (["hit"] + ["x"] * 9) * 160_000  # totals fall, so that nothing is ever joined
    began = time.process_time()
    assert len(toxicity.segments(tokens, {"hit": 1.0}, 0.25)) == 160_000
    assert time.process_time() - began < 5


def test_extreme_value_constants_against_simulated_maxima():
    units = {-5: 9000, 20: 300, 40: 200, 60: 100, -12: 400}
    lam, k = toxicity.karlin(units)
    score, p = np.array(list(units)) * toxicity.GRID, np.array(list(units.values())) / sum(units.values())
    assert abs((p * np.exp(lam * score)).sum() - 1) < 1e-9
    rng, n = np.random.default_rng(1), 2000
    total, best = np.zeros(4000), np.zeros(4000)
    for _ in range(n):
        total = np.maximum(total + rng.choice(score, size=len(total), p=p), 0)
        best = np.maximum(best, total)
    for x in (5.0, 6.0, 8.0, 10.0):
        assert abs((best >= x - 1e-9).mean() - (1 - math.exp(-k * n * math.exp(-lam * x)))) < 0.05
    assert toxicity.karlin({}) == toxicity.karlin({3: 1}) == toxicity.karlin({-3: 5}) == (1.0, 1.0)


def test_toxicity_held_out_on_the_given_table(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = queries.op3_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.005 * n[0, 0]


def test_toxicity_labels_with_repeats_and_nulls(spark):
    texts = [(i, f"{'vile scum ' if i % 2 else ''}plain words here {i}", i, None) for i in range(60)]
    docs = spark.createDataFrame([*texts, (3, "vile again", 0, None), (None, "vile", 0, None)], "doc_id long, text string, toxic long, n long")
    marks = [(i, i % 2) for i in range(60)]
    plain = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    noisy = toxicity.fit(docs, spark.createDataFrame([*marks, (1, 0), (5, None), (None, 1), (999, 1)], "doc_id long, toxic int"))
    assert plain == noisy and plain.lexicon["vile"] > 0
    assert toxicity.score(docs, plain).count() == 62


def test_mixing_reaches_targets(spark, docs, none):
    rng = random.Random(2)
    tongue = {"en": ["the", "of", "and", "house"], "fr": ["le", "des", "et", "maison"], "de": ["der", "und", "das", "haus"], "es": ["el", "los", "y", "casa"]}
    rows = [(i, " ".join(rng.choice(tongue[g]) for _ in range(rng.randrange(20, 80))), g, "s", 0) for i, g in enumerate(rng.choices(list(tongue), [6, 2, 1, 1], k=400))]
    d = spark.createDataFrame([*rows, (None, None, None, None, None)], DOCS)
    for keep_all in (False, True):
        out = mixing.mix(d, d.select("doc_id"), queries.TARGETS, keep_all=keep_all).collect()
        mass = Counter()
        for r in out:
            for g, p in r["posteriors"].items():
                mass[g] += r["rate"] * r["n_tokens"] * p
        assert all(abs(mass[g] / sum(mass.values()) - t) < 1e-3 for g, t in queries.TARGETS.items())
        assert len(out) == 401 and all(abs(sum(r["posteriors"].values()) - 1) < 1e-9 for r in out)
        assert all(r["rate"] >= 1 and r["n_copies"] >= 1 for r in out) if keep_all else True
        assert all(int(r["rate"]) <= r["n_copies"] <= int(r["rate"]) + 1 for r in out)
    mixed = mixing.mixed_rows(d, d.select("doc_id"), queries.TARGETS, keep_all=True)
    assert mixed.columns == d.columns and {r["doc_id"] for r in mixed.select("doc_id").collect()} == {r[0] for r in rows} | {None}
    assert mixing.mix(none, none, queries.TARGETS).count() == 0 and mixing.mix(docs, none, queries.TARGETS).count() > 0


def base_counts(text):
    w = words_of(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, none):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs).collect())
    want = Counter()
    for i, t, *_ in ROWS:
        c = base_counts(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want and quality.judge(none).count() == 0


def test_quality_shares_are_made_once(spark):
    """The verdict adds up each histogram once for a row, whatever the number of languages; its distances are the plain ones."""
    d = spark.createDataFrame([(i, prose(120, random.Random(i)), lang, "s", None) for i, lang in enumerate(quality.LANGUAGES)], DOCS)
    was = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = quality.judge(d).where("kept").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", was)
    plan = re.sub(r"#\d+L?", "", plan)
    assert 1 <= plan.count("aggregate(common") <= 2 and 1 <= plan.count("aggregate(classes") <= 2
    p, q = (0.5, 0.0, 0.25, 0.25, 0.0), (0.0, 0.3, 0.6, 0.1, 0.0)
    part = lambda x, m: x * math.log2(x / m) if x else 0.0
    want = math.sqrt(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2)
    got = spark.range(1).select(quality.jensen_shannon(F.array(*[F.lit(x) for x in p]), list(q))).first()[0]
    assert got == pytest.approx(want, abs=1e-12)


def test_quality_rejects_other_distributions(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 600").limit(300)
    junk = spark.createDataFrame([(-1, "#%&$ 9381 " * 120 + prose(30), "en", "s", 0), (-2, " ".join(str(RNG.randrange(10**6)) for _ in range(200)), "en", "s", 0)], DOCS)
    out = {r["doc_id"]: r for r in quality.judge(real.unionByName(junk)).collect()}
    assert not out[-1]["kept"] and not out[-2]["kept"]
    kept = quality.keep_good(real.unionByName(junk))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]} and kept.columns == real.columns


def test_pieces_equal_the_library(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    extra = spark.createDataFrame([(100, "  two  spaces\tand\nlines 日本 😀 ▁ x", "", "", 0), (101, "naïve café ŵ", "", "", 0), (102, "a" * 500, "", "", 0)], DOCS)
    rows = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    coded = pieces.encode(rows, queries.PIECE_MODEL)
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    want = Counter((i, tuple(sp.encode(t or ""))) for i, t in texts)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded.collect()) == want
    back = pieces.decode(coded, queries.PIECE_MODEL)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, sp.decode(sp.encode(t or ""))) for i, t in texts)
    assert pieces.encode(none, queries.PIECE_MODEL).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b <|im_end|> \\ x"), (1, 0, "user", "a\n<|im_start|>"), (2, 0, "system", None), (2, 1, "assistant", ""), (2, 2, None, "z"), (None, 0, "user", "n"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same")]
    rows += [(4, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(50)]
    got = {r["conv_id"]: r for r in chat.format_digests(spark.createDataFrame(rows, TURNS)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out = chat.chatml([(r, x) for _, r, x in turns])
        assert tuple(got[c])[1:7] == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out), hashlib.sha256(out.encode()).hexdigest())
    assert chat.format_digests(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_detects_rewritten_history(spark):
    rewriting = lambda ms: f"[{len(ms)}]" + "".join(t for _, t in ms)
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], TURNS)
    assert chat.format_digests(rows, rewriting).first()["rewrites_history"]
    spans = chat.render_turns(rows).orderBy("turn").collect()
    assert [r["added"][r["content_start"] : r["content_end"]] for r in spans] == ["a", "b"] and [r["loss"] for r in spans] == [False, True]


def test_chat_detects_rewriting_after_many_turns(spark):
    last = lambda ms: chat.chatml(ms[-32:])
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(40)], TURNS)
    assert chat.format_digests(rows, last).first()["rewrites_history"]
    spans = chat.render_turns(rows, last).orderBy("turn").collect()
    assert [r["added"] is None for r in spans] == [i >= 32 for i in range(40)]
    whole = chat.render_turns(rows).orderBy("turn").collect()
    assert whole == chat.render_turns(rows, window=16).orderBy("turn").collect() and all(r["added"] for r in whole)


def test_licenses(spark, docs, none):
    planted = [(1000, f"{prose(30)}\nLicensed under the Apache License, Version 2.0.\n{prose(20)}", "apache-2.0"), (1001, "Released under the MIT License.", "mit"), (1002, f"{prose(200)} " + licenses.PASSAGES["bsd"][0] + f" {prose(100)}", "bsd"), (1003, "Published under CC BY-SA 4.0", "cc-by-sa")]
    clean = [(2000, "The driving licence was issued in June.", None), (2001, "Permission was given to walk free of charge in the park.", None), (2002, "Under the Heron Terms, version 9, anyone may look.", None)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in planted + clean], "doc_id long, text string"))
    model = licenses.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    out = [(r["doc_id"], {h["family"] for h in r["hits"] if h["confirmed"]}) for r in licenses.scan(d, model).collect()]
    found = dict((i, f) for i, f in out if i is not None and i >= 1000)
    assert all(found[i] == {f} for i, _, f in planted) and all(not found[i] for i, *_ in clean)
    assert len(out) == d.count() and not any(f for i, f in out if i is None or i < 1000)
    assert licenses.scan(none, model).count() == 0 and licenses.scan(d, licenses.fit(none)).count() == d.count()


def test_licenses_in_wrapped_lines(spark, none):
    wrapped = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser\nGeneral Public License as published by the Free Software Foundation; either\nversion 2.1 of the License, or any later version."
    d = spark.createDataFrame([(1, f"{prose(30, random.Random(1))}\n\n{wrapped}\n\nThe end."), (2, "Licensed under the GNU Lesser\nGeneral Public License, version 3.")], "doc_id long, text string")
    model = licenses.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    hits = {r["doc_id"]: [(h["line"], h["family"]) for h in r["hits"] if h["confirmed"]] for r in licenses.scan(d, model).collect()}
    assert hits == {1: [(2, "lgpl")], 2: [(0, "lgpl")]}


def test_simhash_edits(spark, none):
    rows = [(i, t) for i, (_, t, *_) in enumerate(ROWS)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.edited_likeness(d).collect()}
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(d).collect()}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == f"{prints[i] & (1 << 64) - 1:016x}"
        other = int(got[rows[(k + 1) % len(rows)][0]]["fingerprint"], 16)
        assert abs(r["near_next"] - (1 - (int(r["fingerprint"], 16) ^ other).bit_count() / 64)) < 1e-12
        assert abs(r["near_edited"] - (1 - (int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).bit_count() / 64)) < 1e-12
    same = defaultdict(set)
    for i, t in rows:
        same[t or ""].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values()) and simhash.edited_likeness(none).count() == 0


def test_simhash_radius(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    every = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(4)})
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    got = {(r["a"], r["b"], r["distance"]) for r in simhash.within(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), 3).collect()}
    want = {(min(a, b), max(a, b), (a ^ b & (1 << 64) - 1).bit_count() if a >= 0 and b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count()) for i, a in enumerate(signed) for b in signed[:i]}
    assert got == {w for w in want if w[2] <= 3} and got


@pytest.mark.parametrize("bucket", [4, 512])
def test_simhash_neighbours_of_every_document(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    base = [prose(300, rng) for _ in range(12)]
    rows = [(i, base[i % 12] + (f" end{i}" if i % 3 else "")) for i in range(90)] + [(90, None), (91, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] & (1 << 64) - 1 for r in simhash.fingerprints(d).collect()}
    near = {i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3] for i in prints}
    got = {r["doc_id"]: (r["fingerprint"], r["n_within"], r["least_id"]) for r in simhash.neighbours(d).collect()}
    assert got == {i: (f"{prints[i]:016x}", len(near[i]) - 1, min(near[i])) for i in prints}
    assert any(prints[j] != prints[i] for i in near for j in near[i])


def kept_words(rows, n=35):
    seen = Counter(tuple(w[i : i + n]) for _, t, *_ in rows for w in [words_of(t)] for i in range(len(w) - n + 1))
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = {k for j in range(len(w) - n + 1) if seen[tuple(w[j : j + n])] > 1 for k in range(j, j + n)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substrings(docs, none):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.drop_repeated_windows(docs, 35).collect())
    assert got == Counter(kept_words(ROWS)) and substring.drop_repeated_windows(none).count() == 0


def test_substrings_keep_layout(docs):
    rows = substring.drop_repeated_windows(docs, 35, layout=True, carry=("lang", "source")).collect()
    assert Counter((r["doc_id"], " ".join(words_of(r["kept_text"]))) for r in rows) == Counter((i, k) for i, _, _, k in kept_words(ROWS))
    whole = Counter((i, t) for i, t, *_ in ROWS)
    assert all((r["doc_id"], r["kept_text"]) in whole for r in rows if not r["n_removed"]) and {r["carried"]["source"] for r in rows} == {"s"}


@pytest.mark.parametrize("flush, heavy, part", [(1, 1, 1 << 12), (300, 10_000, 256 << 20), (1_000_000, 2, 1 << 14)])
def test_substrings_that_all_documents_hold(spark, monkeypatch, flush, heavy, part):
    """Whatever a task gathers before it sends, however many parts there are and whichever copies stay apart."""
    monkeypatch.setattr(substring, "FLUSH_WORDS", flush)
    monkeypatch.setattr(substring, "HEAVY", heavy)
    monkeypatch.setattr(substring, "PART_BYTES", part)
    rng = random.Random(21)
    passage, other = prose(80, rng), prose(36, rng)
    texts = [f"{prose(rng.randrange(40), rng)} {passage} {prose(5, rng)}" for _ in range(60)] + [f"{other} x{i} {other}" for i in range(3)]
    texts += [texts[0]] * 30 + [texts[5]] * 2 + ["short copy"] * 5 + [None, None, "", prose(400, rng), " ".join(["again"] * 90)]
    rows = [(i if i % 9 else None, t, "en", "s", 0) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, DOCS)
    for repartitioned in (d.repartition(1), d.repartition(7)):
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.drop_repeated_windows(repartitioned, 35).collect())
        assert got == Counter(kept_words(rows))


def test_a_passage_that_all_hold_is_sent_once_for_a_million_words():
    rng = random.Random(2)
    passage = prose(60, rng)
    texts = [f"{passage} {prose(10, rng)}".encode() for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).digest()[:16] for t in texts]), pa.array([t.decode() for t in texts])], names=["key", "text"])
    sent = [r for b in substring._anchors(np.arange(4, dtype=np.int32), 35)(iter([batch])) for r in b.to_pylist()]
    compared = sum(len(r["h1"]) // 4 for r in sent if r["h1"] is not None)
    passed = sum(len(r["low"]) // 2 for r in sent if r["h1"] is None)
    assert passed >= 400 * 10 and compared <= 400 * 6


def test_sharding_is_close_to_one_global_schedule(spark):
    rng = random.Random(8)
    texts = [prose(int(rng.paretovariate(1.1) * 6) % 900 + 1, rng) for _ in range(1500)]
    texts += [texts[0]] * 40
    size = defaultdict(Counter)
    for r in sharding.lpt_shards(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 8).collect():
        size["ours"][r["shard"]] += r["size"]
    groups = Counter(texts)
    for load in sorted(((len(t.encode()) + 1) * n for t, n in groups.items()), reverse=True):
        size["global"][min(range(8), key=lambda s: size["global"][s])] += load
    spread = {k: max(v.values()) - min(v.values()) for k, v in size.items()}
    assert sum(size["ours"].values()) == sum(size["global"].values())
    assert spread["ours"] <= spread["global"] + 0.002 * sum(size["ours"].values())
