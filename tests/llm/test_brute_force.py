"""Operators without SQL against plain Python on given tables, and awkward inputs that all of them must take."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import chat, common, licenses, mixing, neardup, pieces, quality, queries, sharding, simhash, substring, toxicity
from tests.llm.test_operators import DOCS, near_components, prose, words_of

MASK = (1 << 64) - 1


def spark_hash(*words):
    """Spark's xxhash64 of several strings."""
    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return h


def plain_simhash(text):
    w = words_of(text)
    hashes = [spark_hash(*w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [spark_hash(" ".join(w))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_in_plain_python(spark):
    rng = random.Random(4)
    texts = [prose(rng.randrange(0, 60), rng) for _ in range(80)] + ["", "one", "é ü 語 x", "a b c d e", None, "x " * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] & MASK for r in simhash.fingerprints(d).collect()}
    assert got == {i: plain_simhash(t or "") for i, t in enumerate(texts)}
    edited = {r["doc_id"]: r for r in simhash.edited_likeness(d).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        assert int(edited[i]["edited_fingerprint"], 16) == plain_simhash(t[: len(t) - cut] + nxt[:cut])


def test_mixing_posteriors_and_rates_in_plain_python(spark):
    rng = random.Random(6)
    tongue = {"en": ["the", "of", "and", "House"], "fr": ["le", "des", "et", "maison"], "de": ["der", "und", "das", "haus"], "es": ["el", "los", "y", "casa"]}
    rows = [(i, " ".join(rng.choice(tongue[g]) for _ in range(rng.randrange(0, 50))), g, "s", 0) for i, g in enumerate(rng.choices(list(tongue), [6, 2, 1, 1], k=200))]
    d = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in mixing.mix(d, d.where("doc_id % 2 = 0").select("doc_id"), queries.TARGETS).collect()}
    domains = sorted(queries.TARGETS)
    bucket = lambda w: ((h := spark_hash(w.lower())) - (1 << 64) * (h >> 63)) % mixing.BUCKETS
    counts = {g: Counter() for g in domains}
    sizes = Counter()
    for i, t, g, *_ in rows:
        if i % 2 == 0:
            counts[g].update(map(bucket, words_of(t)))
            sizes[g] += 1
    total = {g: sum(counts[g].values()) + mixing.BUCKETS for g in domains}
    mass = Counter()
    for i, t, *_ in rows:
        w = words_of(t)
        z = [math.log((sizes[g] + 1) / (sum(sizes.values()) + 4)) + sum(math.log((counts[g][bucket(x)] + 1) / total[g]) for x in w) / math.sqrt(max(len(w), 1)) for g in domains]
        e = [math.exp(x - max(z)) for x in z]
        for g, x in zip(domains, e, strict=True):
            assert abs(out[i]["posteriors"][g] - x / sum(e)) < 1e-9
            mass[g] += out[i]["rate"] * len(w) * x / sum(e)
    assert all(abs(mass[g] / sum(mass.values()) - share) < 1e-6 for g, share in queries.TARGETS.items())
    assert abs(sum(mass.values()) - sum(len(words_of(t)) for _, t, *_ in rows)) < 1e-3 and min(r["rate"] for r in out.values()) >= 0


def test_near_duplicates_of_a_given_table(spark):
    """Every link at 0.8 of five-word shingles, on all documents of a table: none is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    sets, root = near_components(rows, 5)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: least[r] for (i, _), r in zip(rows, root, strict=True)}
    assert len(set(got.values())) < len(got) and any(len(sets[a]) != len(sets[b]) for a in range(len(rows)) for b in [root[a]])


def test_licences_of_a_given_table(spark):
    """Documents with a family's notice, found by a plain search for the names in the frames: recall and precision."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    frames = "|".join(re.escape(f.split("{}")[0]) for f in licenses.FRAMES if len(f.split("{}")[0]) > 9)
    names = "|".join(re.escape(n) for ns in licenses.NAMES.values() for n in sorted(ns, key=len, reverse=True))
    notice = re.compile(rf"(?:{frames})\s*(?:the )?(?:{names})\b", re.I)
    told = {r["doc_id"] for r in docs.collect() if notice.search(r["text"] or "")}
    model = licenses.fit(docs)
    sure = F.exists("hits", lambda h: h["confirmed"])
    got = {r["doc_id"] for r in licenses.scan(docs, model).where(sure).select("doc_id").collect()}
    assert told and len(got & told) >= 0.95 * len(told), (len(told), len(got & told))
    again = licenses.fit(docs)
    assert (again.weights == model.weights).all() and (again.vocabulary == model.vocabulary).all()


def drops_old(ms):
    return chat.chatml(ms[-20:])


def summarises(ms):
    return chat.chatml(ms if len(ms) < 30 else [("system", f"{len(ms) - 5} turns"), *ms[-5:]])


def moves_system(ms):
    return chat.chatml([m for m in ms if m[0] != "system"] + [m for m in ms if m[0] == "system"])


@pytest.mark.parametrize("template, first", [(drops_old, 20), (summarises, 29), (moves_system, 31)])
def test_templates_that_rewrite_history_late(spark, template, first):
    turns = [(1, i, "system" if i == 30 else "assistant" if i % 2 else "user", f"turn {i}") for i in range(40)]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    spans = chat.render_turns(d, template).orderBy("turn").collect()
    assert [r["turn"] for r in spans if r["added"] is None][0] == first
    assert chat.format_digests(d, template).first()["rewrites_history"]
    assert not chat.format_digests(d.where(F.col("turn") < first), template).first()["rewrites_history"]


def test_turns_with_several_texts_and_other_columns(spark):
    rows = [(1, 0, "user", "b", 1, 2), (1, 0, "user", "a", 1, 2), (1, 1, "assistant", "c", 1, 2), (1, None, "user", "first", 1, 2)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns long, loss long")
    r = chat.format_digests(d).first()
    assert r["n_turns"] == 4 and r["turns_sha256"] == hashlib.sha256(b"user\nfirst\nuser\na\nuser\nb\nassistant\nc\n").hexdigest()


CLASH = "doc_id long, text string, lang string, source string, n_chars long, key long, h long, label long, score long, toxic long, rk long, fp long, w long, tokens long, copies long, ids long, hits long, salt long, component_id long"


def awkward(spark, texts):
    rows = [(i if i % 11 != 5 else None, t, ["en", "fr", None][i % 3], "s", 0, *[1] * 14) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    texts = [prose(rng.randrange(0, 150), rng) for _ in range(40)]
    return awkward(spark, [*texts, *texts[:5], None, None, "", "  \n", prose(250_000, rng), "y" * 1_500_000, "\n" * 100_000])


def test_all_operators_take_long_texts_and_clashing_columns(spark, clashing):
    n = clashing.count()
    labels = clashing.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(3).alias("text"))
    assert sharding.lpt_shards(clashing).select(F.count("slot")).first()[0] == n
    assert neardup.near_duplicates(clashing).count() == n and neardup.deduplicated(clashing).columns == clashing.columns
    assert toxicity.score(clashing, toxicity.fit(clashing, labels)).count() == n
    mixed = mixing.mixed_rows(clashing, labels, queries.TARGETS, keep_all=True)
    assert mixed.columns == clashing.columns and mixed.count() >= n
    assert quality.judge(clashing).count() == n and quality.keep_good(clashing).columns == clashing.columns
    assert pieces.encode(clashing, queries.PIECE_MODEL).where("round_trip").count() >= n - 1
    assert licenses.scan(clashing, licenses.fit(clashing)).count() == n
    assert simhash.edited_likeness(clashing).count() == n and simhash.neighbours(clashing).count() == n
    assert substring.drop_repeated_windows(clashing).count() == n


def test_quality_without_a_known_language(spark):
    d = spark.createDataFrame([(1, prose(80), "xx", "s", 0), (2, prose(10), None, "s", 0)], DOCS)
    out = {r["doc_id"]: r for r in quality.judge(d).collect()}
    assert out[1]["kept"] and out[1]["class_distance"] == 0 and not out[2]["kept"]


def test_radius_search_takes_nulls_and_empty_tables_and_dense_clusters(spark):
    none = spark.createDataFrame([], "fingerprint long")
    assert simhash.within(none).count() == 0
    dense = [x for b in range(64) for x in [1 << b if b < 63 else -(1 << 63)]] + [0, None, None]
    got = simhash.within(spark.createDataFrame([(x,) for x in dense], "fingerprint long"), 2)
    assert got.count() == 65 * 64 // 2 and got.agg(F.max("distance")).first()[0] == 2


@pytest.mark.parametrize("texts", [[], [None, "", None], ["short"] * 3])
def test_pipeline_stages_on_awkward_tables(spark, texts):
    docs = spark.createDataFrame([(None, t, None, None, None) for t in texts], DOCS)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() <= len(texts) or i == 3  # mixing may ask for more copies
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)


def test_pipeline_run_equals_its_stages_and_cleans_up(spark, tmp_path):
    sf, before = "/root/testdata/sf0.001", len(common._STAGED)
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_pieces", "ids_sha256").collect())
    assert len(common._STAGED) <= before + 4
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert got == Counter(tuple(r) for r in docs.select("doc_id", "n_pieces", "ids_sha256").collect()) and got
    ids = [pieces.PieceTransducer(pieces.model_bytes(queries.PIECE_MODEL)).decode(r["ids"]) for r in docs.limit(5).collect()]
    assert all(len(words_of(t)) > 0 for t in ids)


def test_mixing_stage_in_the_pipeline_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    mixed = mixing.mix(docs, labels, queries.TARGETS, keep_all=True).collect()
    mass = Counter()
    for r in mixed:
        for g, p in r["posteriors"].items():
            mass[g] += r["rate"] * r["copies"] * r["n_tokens"] * p
    assert all(abs(mass[g] / sum(mass.values()) - share) < 1e-3 for g, share in queries.TARGETS.items())
    out = corpus_pipeline.to_targets(spark, docs, "/root/testdata/sf0.01")
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({r["doc_id"]: r["n_copies"] for r in mixed})
