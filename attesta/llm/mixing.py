"""Mixing to target weights with soft domain membership, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import pick, staged
from attesta.llm.quality import words_of
from attesta.llm.simhash import _rows, row_key

BUCKETS = 4096


def buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int"))


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], *, id_col: str, text_col: str, domain_col: str, sample_rows: int = 20_000) -> tuple[DataFrame, list[float]]:
    """Word-bucket log-probabilities of each domain (a table of at most ``BUCKETS`` rows) and log-priors.

    Fits on at most ``sample_rows`` labelled documents, those of lowest id hash, of rows that repeat an id one; domains
    that aren't asked for and nulls are left out. A domain without labelled documents gets the uniform distribution.
    """
    ids = pick(labelled, doc_id=id_col).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = pick(docs, doc_id=id_col, text=text_col, domain=domain_col).where(F.col("domain").isin(*domains)).join(F.broadcast(ids), "doc_id")  # sample_rows ids at most
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text", "domain").alias("h"), "text", "domain")).alias("r")).select("r.text", "r.domain")
    rows = staged(rows, "mixing-sample")  # sample_rows texts
    words = rows.withColumn("w", words_of(F.coalesce("text", F.lit("")))).select("domain", F.explode(buckets(F.col("w"))).alias("bucket"))
    counts = np.ones((BUCKETS, len(domains)))
    for r in words.groupBy("domain", "bucket").count().collect():  # BUCKETS x domains rows at most
        counts[r["bucket"], domains.index(r["domain"])] += r["count"]
    logs = np.log(counts / counts.sum(0))
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    prior = [math.log((sizes.get(d, 0) + 1) / (sum(sizes.values()) + len(domains))) for d in domains]
    table = docs.sparkSession.createDataFrame([(i, *map(float, logs[i])) for i in range(BUCKETS)], "bucket int, " + ", ".join(f"l{k} double" for k in range(len(domains))))
    return table, prior


def posteriors(docs: DataFrame, model: tuple[DataFrame, list[float]], *, id_col: str, text_col: str) -> DataFrame:
    """``rk, doc_id, copies, tokens, p`` of each distinct row; a text without words has the prior.

    The log-likelihood is divided by the square root of the length, which keeps membership soft.
    """
    table, prior = model
    k = len(prior)
    d = _rows(docs, id_col, text_col).withColumn("w", words_of(F.col("text")))
    words = d.select("rk", "doc_id", F.posexplode_outer(buckets(F.col("w"))).alias("i", "bucket"))
    met = words.join(F.broadcast(table), "bucket", "left")  # BUCKETS rows
    sums = met.groupBy("rk", "doc_id").agg(F.count("bucket").alias("n"), F.count(F.when(F.coalesce("i", F.lit(0)) == 0, 1)).alias("copies"), *[F.sum(f"l{j}").alias(f"s{j}") for j in range(k)])
    logit = [F.lit(prior[j]) + F.coalesce(F.col(f"s{j}") / F.col("copies"), F.lit(0.0)) / F.sqrt(F.greatest(F.col("n") / F.col("copies"), F.lit(1.0))) for j in range(k)]
    sums = sums.withColumn("z", F.array(*logit)).withColumn("top", F.array_max("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top"))))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return sums.select("rk", "doc_id", "copies", (F.col("n") / F.col("copies")).cast("long").alias("tokens"), F.transform("e", lambda x: x / total).alias("p"))


@dataclass
class Rates:
    """``rate = max(lower, ... max(lower, 1 - p.g1) ... - p.gT)`` with the steps g of the projected gradient."""

    steps: list[list[float]]
    lower: float
    start: float
    shares: list[float]
    #: The largest distance of an expected domain share from its target, in shares of the table's tokens.
    residual: float = 0.0

    def column(self, p: Column) -> Column:
        rate = F.lit(float(self.start))
        for g in self.steps:
            dot = sum((F.get(p, F.lit(i)) * F.lit(float(x)) for i, x in enumerate(g)), F.lit(0.0))
            rate = F.greatest(F.lit(float(self.lower)), rate - dot)
        return rate


def fit_rates(members: DataFrame, targets: list[float], *, lower: float = 0.0, keep_all: bool = False, most_steps: int = 25, tolerance: float = 1e-7) -> Rates:
    """Least squares over document rates by projected gradient, with one aggregate of the table for each step.

    Minimises the squared distance of expected domain tokens, sum(rate * tokens * p), from ``targets`` times the budget.
    The gradient is taken in the metric of the domains' Gram matrix, so a step without a bound that bites is exact. The
    budget is the table's tokens; with ``keep_all`` rates stay at 1 or more and the budget grows until no domain has to
    shrink, so no document is lost. Only the steps (a number for each domain) reach the driver. ``shares`` and ``residual``
    of the result say what was reached: a target that bounds put out of reach leaves a residual above ``tolerance``.
    """
    k = len(targets)
    b = np.array(targets, float) / sum(targets)
    w = F.col("tokens") * F.col("copies")
    gram = [F.sum(w * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(k)]
    first = members.agg(F.coalesce(F.sum(w), F.lit(0)).cast("double"), *[F.sum(w * F.col("p")[i]) for i in range(k)], *gram).first()
    total = first[0] or 0.0
    if not total:
        return Rates([], lower, 1.0, [0.0] * k)
    have = np.array(first[1 : k + 1], float) / total
    inverse = np.linalg.pinv(np.array(first[k + 1 :], float).reshape(k, k) / total + 1e-12 * np.eye(k))
    budget = 1.0
    if keep_all:
        lower = max(lower, 1.0)
        budget = max(1.0, float(np.max(have / np.maximum(b, 1e-9))))
    rates = Rates([], lower, 1.0, have.tolist())
    for _ in range(most_steps):
        r = rates.column(F.col("p"))
        now = np.array(members.agg(*[F.sum(w * r * F.col("p")[i]) for i in range(k)]).first(), float) / total if rates.steps else have
        residual = now - budget * b
        rates.shares, rates.residual = (now / now.sum()).tolist(), float(np.abs(residual).max())
        if np.abs(residual).max() < tolerance or (len(rates.steps) > 2 and np.abs(residual - before).max() < tolerance / 100):
            break
        before = residual
        rates.steps.append((inverse @ residual).tolist())
    return rates


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", lower: float = 0.0, keep_all: bool = False) -> DataFrame:
    """``rk, doc_id, n_tokens, posteriors, rate, n_copies`` of each distinct row (id and text), with ``copies`` of it.

    ``labelled`` names the documents whose ``domain_col`` the classifier learns; every document's membership is then
    soft. ``n_copies`` rounds the rate up or down by a hash of the row, with the rate as its expectation. Null ids and
    texts are allowed; a text without words has the prior's membership and no tokens. Rows equal in id and text share
    one rate. An empty table gives no rows.
    """
    domains = sorted(targets)
    model = train(docs, labelled, domains, id_col=id_col, text_col=text_col, domain_col=domain_col)
    members = staged(posteriors(docs, model, id_col=id_col, text_col=text_col), "mixing-members")
    rates = fit_rates(members, [targets[d] for d in domains], lower=lower, keep_all=keep_all)
    u = F.pmod(F.xxhash64("rk", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    out = members.withColumn("rate", rates.column(F.col("p")))
    return out.select("rk", "doc_id", "copies", F.col("tokens").alias("n_tokens"), F.map_from_arrays(F.array(*[F.lit(d) for d in domains]), "p").alias("posteriors"), "rate", F.floor(F.col("rate") + u).cast("int").alias("n_copies"))


def mixed_rows(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", lower: float = 0.0, keep_all: bool = False) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as ``mix`` says."""
    rates = mix(docs, labelled, targets, id_col=id_col, text_col=text_col, domain_col=domain_col, lower=lower, keep_all=keep_all)
    times = rates.where("n_copies > 0").select(F.col("rk").alias("__rk"), "n_copies")
    names = docs.columns
    out = docs.withColumn("__rk", row_key(docs[id_col], docs[text_col])).join(times, "__rk")
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times["n_copies"]))).select(*[docs[c] for c in names])
