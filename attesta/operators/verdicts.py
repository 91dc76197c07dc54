"""Verdicts and what is counted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.stats import ratio



def reachability(ok: Column, paywall: Column, retraction: Column) -> Column:
    """Not ok is unreachable; a wall comes before a retraction; the rest is supported so far."""
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(K.UNREACHABLE)).when(paywall, F.lit(K.PAYWALLED)).when(retraction, F.lit(K.UNSUPPORTED)).otherwise(F.lit(K.SUPPORTED))


def reachability_notes(status: Column, error: Column, text: Column) -> Column:
    return (
        F.when((status == K.UNREACHABLE) & error.isNotNull(), F.array(error))
        .when(status == K.UNREACHABLE, F.array().cast("array<string>"))
        .when(status == K.PAYWALLED, F.array(F.lit("a paywall or login wall is on the cited page")))
        .when(status == K.UNSUPPORTED, F.array(F.lit("the cited page is marked as retracted")))
        .when(F.coalesce(text, F.lit("")) != "", F.array(F.lit("page reachable, no red flags")))
        .otherwise(F.array(F.lit("page fetched without extractable text")))
    )


def label(status: Column, strict: bool = False) -> Column:
    return F.when(status == K.SUPPORTED, F.lit("PASS")).when(status == K.UNSUPPORTED, F.lit("FAIL")).when((status == K.AMBIGUOUS) & F.lit(strict), F.lit("FAIL (strict)")).otherwise(F.lit("UNVERIFIABLE"))


def passes(status: Column) -> Column:
    return status == K.SUPPORTED


def rollup(verdicts: DataFrame, *keys: str) -> DataFrame:
    """``total, supported, unsupported, unverifiable, pass_rate`` (0 when empty), over all rows or by keys."""
    hit = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = verdicts.groupBy(*keys).agg(F.count("*").alias("total"), hit(K.SUPPORTED), hit(K.UNSUPPORTED))
    rate = F.bround(ratio(F.col("supported"), F.col("total")), 4)
    return counts.select(*keys, "total", "supported", "unsupported", (F.col("total") - F.col("supported") - F.col("unsupported")).alias("unverifiable"), rate.alias("pass_rate"))


def histogram(verdicts: DataFrame, *keys: str) -> DataFrame:
    """A count for each of the five statuses, zeros kept."""
    return verdicts.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in K.VERDICTS])


def exit_code(verdicts: DataFrame, threshold: float = 0.8, strict: bool = False) -> DataFrame:
    """One row: 1 if the pass rate is below the threshold or, with ``strict``, anything is ambiguous or unsupported."""
    bad = F.count_if(F.col("status").isin(K.AMBIGUOUS, K.UNSUPPORTED)) if strict else F.lit(0)
    rate = F.bround(ratio(F.count_if(F.col("status") == K.SUPPORTED), F.count("*")), 4)
    return verdicts.agg(rate.alias("pass_rate"), bad.cast("long").alias("bad")).select("pass_rate", F.when((F.col("pass_rate") < threshold) | (F.col("bad") > 0), F.lit(1)).otherwise(F.lit(0)).alias("exit_code"))
