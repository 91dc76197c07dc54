"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import pick, staged

TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


@dataclass
class ToxicModel:
    """Token scores (log-odds less ``drift``), the drift of all other tokens, Karlin-Altschul constants, a logistic map."""

    lexicon: dict[str, float]
    drift: float
    lam: float
    k: float
    slope: float
    intercept: float
    starts: frozenset[str] = frozenset()


#: A word that the lexicon lacks takes the score of its longest known beginning of so many letters.
STEMS = (7, 6, 5, 4)
MARK = "~"


def stems_of(token: str) -> list[str]:
    """Beginnings of a longer word, marked so that they aren't words."""
    return [token[:k] + MARK for k in STEMS if len(token) > k]


def known_starts(lexicon: dict[str, float]) -> frozenset[str]:
    """The first letters of the beginnings that the lexicon holds: most words need no further look."""
    return frozenset(s[: STEMS[-1]] for s in lexicon if s[-1:] == MARK)


def scored_tokens(tokens: list[str], lexicon: dict[str, float], starts: frozenset[str]) -> list[tuple[int, float]]:
    """(place, score) of the tokens that the lexicon knows, by themselves or by a beginning."""
    least, out = STEMS[-1], []
    for i, t in enumerate(tokens):
        if t in lexicon:
            out.append((i, lexicon[t]))
        elif t[:least] in starts:
            found = next((lexicon[s] for s in stems_of(t) if s in lexicon), None)
            if found is not None:
                out.append((i, found))
    return out


def segments(tokens: list[str], lexicon: dict[str, float], drift: float, starts: frozenset[str] = frozenset()) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a token sequence, in one pass over its scored tokens.

    Each candidate keeps the place of the nearest earlier one with a smaller total before it, so that a search from the
    right jumps over all that an earlier search has ruled out: the whole work is linear.
    """
    out: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest smaller
    total, seen = 0.0, 0
    for i, s in scored_tokens(tokens, lexicon, starts):
        total -= drift * (i - seen)
        seen = i + 1
        before = total
        total += s
        if s <= 0:
            continue
        first, j = i, len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                break
            first, _, before, _, back = out[j]
            del out[j:]
            j = back
        out.append((first, i + 1, before, total, j))
    return [(a, b, r - lo) for a, b, lo, r, _ in out]


def statistic(found: list[tuple[int, int, float]], n: int, model: ToxicModel, e_value: float) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Summed normalised score of the segments whose E-value is low enough, and those segments."""
    kept = []
    for a, b, s in found:
        bits = model.lam * s - math.log(model.k * max(n, 1))
        if math.exp(-min(bits, 700)) <= e_value:
            kept.append((a, b, s, bits))
    return sum(x[3] for x in kept), kept


#: Not a token: under it a class's documents are counted.
DOCUMENTS = ""
#: Scores are rounded to multiples of this for the constants of the extreme-value distribution.
GRID = 0.05


#: Parts of the sample, each of which is scored once by a model of the others.
FOLDS = 3


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: defaultdict[tuple[int, int], Counter] = defaultdict(Counter)
        for text, *where in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
            words = set(tokens_of(text))
            seen[*where].update(words | {s for w in words for s in stems_of(w)})
            seen[*where][DOCUMENTS] += 1
        for (toxic, fold), c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([toxic] * len(c), pa.int32()), pa.array([fold] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["token", "toxic", "fold", "n"])


def _units(lexicon: dict[str, float], drift: float, starts: frozenset[str]):
    """How often running tokens have a score, in multiples of ``GRID``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter = Counter()
            for text in batch.column("text").to_pylist():
                tokens = tokens_of(text)
                hits = scored_tokens(tokens, lexicon, starts)
                c.update(round(s / GRID) for _, s in hits)
                c[round(-drift / GRID)] += len(tokens) - len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["unit", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, lexicon_size: int = 50_000, prior: float = 2.0, false_tokens: float = 0.3, drift: float = 0.25, e_value: float = 0.05) -> ToxicModel:
    """Learns from at most ``sample_rows`` labelled documents (those of lowest id hash; copies of a text count once).

    They give token log-odds of document frequencies (a word repeated in one text counts once) under a Dirichlet prior
    (``prior`` pseudo-documents spread as the sample spreads them, plus a flat share). Tokens whose likelihood ratio G2 is
    so large that chance would give ``false_tokens`` of all tested, at most ``lexicon_size``, form the lexicon; beginnings
    of words are tokens too, for words that it lacks. Running tokens of the clean documents are the background of the
    extreme-value constants. A logistic regression calibrates the document statistic, on what each third of the sample gets
    from a lexicon of the others. Labels that repeat an id count as toxic if any is, of rows that repeat an id one text
    is taken; null labels or ids are skipped. Without both classes the model gives every text the base rate.
    """
    marks = pick(labels, doc_id=id_col, toxic="toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = marks.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample_rows)
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")  # sample_rows ids at most
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(hashed.alias("h"), "text", "toxic")).alias("r")).select("r.*")
    rows = rows.groupBy("h").agg(F.min(F.struct("toxic", "text")).alias("r")).select("r.*", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))
    rows = staged(rows, "toxic-sample")  # sample_rows texts at most
    each = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{y}{k}") for y in (0, 1) for k in range(FOLDS)]
    counts = staged(rows.mapInArrow(_counts, "token string, toxic int, fold int, n long").groupBy("token").agg(*each), "toxic-counts")
    how = (lexicon_size, prior, false_tokens, drift)
    held: Counter = Counter()
    for k in range(FOLDS):
        part = _learnt(rows, counts, [j for j in range(FOLDS) if j != k], *how)
        for r in rows.where(F.col("fold") == k).mapInArrow(_statistics(part, e_value), "x double, toxic int").groupBy("x", "toxic").count().collect():  # a row for each sampled document at most
            held[r["x"], r["toxic"]] += r["count"]
    model = _learnt(rows, counts, list(range(FOLDS)), *how)
    model.slope, model.intercept = _logistic([(x, y, n) for (x, y), n in held.items()])
    return model


def _learnt(rows: DataFrame, counts: DataFrame, folds: list[int], lexicon_size: int, prior: float, false_tokens: float, drift: float) -> ToxicModel:
    """Lexicon and extreme-value constants of some folds, not yet calibrated."""
    counts = counts.select("token", sum(F.col(f"n1{k}") for k in folds).alias("t"), sum(F.col(f"n0{k}") for k in folds).alias("o"))
    totals = counts.where(F.col("token") == DOCUMENTS).first()
    n_t, n_o = (float(totals["t"]), float(totals["o"])) if totals else (0.0, 0.0)
    lexicon: dict[str, float] = {}
    lam, k = 1.0, 1.0
    if n_t and n_o:
        t, o = F.col("t"), F.col("o")
        a = F.lit(prior) * (t + o) / (n_t + n_o) + 0.25
        delta = F.log((t + a) / (n_t + prior - t)) - F.log((o + a) / (n_o + prior - o))
        share = n_t / (n_t + n_o)
        part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        tested = counts.where((F.col("token") != DOCUMENTS) & (t + o >= 3))
        scored = tested.select("token", delta.alias("delta"), (2 * (part(t, (t + o) * share) + part(o, (t + o) * (1 - share)))).alias("g2"))
        best = scored.where(F.col("g2") >= chance(false_tokens / max(1, tested.count()))).orderBy(F.desc("g2"), "token").limit(lexicon_size).collect()  # bounded by the sample's parameters
        lexicon = {r["token"]: float(r["delta"]) - drift for r in best}
        clean = rows.where(F.col("fold").isin(folds) & (F.col("toxic") == 0)).select("text").mapInArrow(_units(lexicon, drift, known_starts(lexicon)), "unit int, n long")
        lam, k = karlin({r["unit"]: r["n"] for r in clean.groupBy("unit").agg(F.sum("n").alias("n")).collect()})  # a row for each multiple of GRID
    return ToxicModel(lexicon, drift, lam, k, 0.0, 0.0, known_starts(lexicon))


def chance(p: float) -> float:
    """The value that a chi-squared variable of one degree of freedom exceeds with probability ``p``."""
    lo, hi = 0.0, 1500.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) > p else (lo, mid)
    return (lo + hi) / 2


def karlin(units: dict[int, int], most_terms: int = 400) -> tuple[float, float]:
    """Lambda and K of the largest segment score over independent tokens, P(max >= x) ~ 1 - exp(-K n exp(-lambda x)).

    ``units`` counts scores in multiples of ``GRID``. Lambda solves E[exp(lambda s)] = 1; K is the series of Karlin and
    Altschul for lattice scores, with the distributions of sums of 1, 2, ... tokens by convolution. (1, 1) where scores
    don't fall on average or never rise.
    """
    total = sum(units.values())
    if not total or sum(s * n for s, n in units.items()) >= 0 or max(s for s, n in units.items() if n) <= 0:
        return 1.0, 1.0
    s = np.array(sorted(u for u in units if units[u]))
    p = np.array([units[int(u)] for u in s], float) / total
    span = int(np.gcd.reduce(s))
    s = s // span
    lo, hi = 0.0, 700.0 / s[-1]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    lam = (lo + hi) / 2
    one = np.zeros(s[-1] - s[0] + 1)
    one[s - s[0]] = p
    now, low, series = np.ones(1), 0, 0.0
    for j in range(1, most_terms + 1):
        now, low = np.convolve(now, one), low + int(s[0])
        keep = np.flatnonzero(now > 1e-18)
        now, low = now[keep[0] : keep[-1] + 1], low + int(keep[0])
        x = np.arange(low, low + len(now))
        term = now[x >= 0].sum() + (now[x < 0] * np.exp(lam * x[x < 0])).sum()
        series += term / j
        if term < 1e-6:
            break
    k = math.exp(-2 * series) / ((p * s * np.exp(lam * s)).sum() * -math.expm1(-lam))
    return lam / (GRID * span), max(k, 1e-12)


def _statistics(model: ToxicModel, e_value: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = []
            for text in batch.column("text").to_pylist():
                t = tokens_of(text)
                xs.append(statistic(segments(t, model.lexicon, model.drift, model.starts), len(t), model, e_value)[0])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.float64()), batch.column("toxic").cast(pa.int32())], names=["x", "toxic"])

    return run


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge; x enters as log1p."""
    if not rows:
        return 0.0, 0.0
    x, y, w = (np.array(v, float) for v in zip(*rows, strict=True))
    x = np.log1p(np.maximum(x, 0))
    a = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - np.array([1e-2, 1e-2]) * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-2])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


SCORED = "doc_id long, score double, passages array<struct<start:int,end:int,score:double,bits:double>>"


def score(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text", e_value: float = 0.05) -> DataFrame:
    """``doc_id, score, passages`` of each row: the probability of the toxic label and every significant passage
    (token offsets, raw score, normalised bits). A word that the lexicon lacks takes the score of its longest known
    beginning (of ``STEMS`` letters), any other token minus the drift. A null or empty text has no passage and the base
    score; ids may be null or repeat; an empty table gives no rows. Time is linear in a text, memory beside it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("bits", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for text in batch.column("text").to_pylist():
                t = tokens_of(text)
                x, kept = statistic(segments(t, model.lexicon, model.drift, model.starts), len(t), model, e_value)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * math.log1p(max(x, 0)) + model.intercept)))))
                passages.append([{"start": a, "end": b, "score": s, "bits": bits} for a, b, s, bits in kept])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCORED)
