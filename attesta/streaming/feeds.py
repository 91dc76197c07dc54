"""Streams, as an extension: verdicts of arriving documents, a page cache that forgets, and windowed pass rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.stats import ratio
from attesta.functions.urls import normalized
from attesta.operators.entailment import Scorer
from attesta.plans.verify import verify


def verdict_stream(citations: DataFrame, pages: DataFrame, *, use_overlap: bool = True, scorer: Scorer | None = None) -> DataFrame:
    """Verdicts of a stream of citations against a table of pages: the batch plan, as a stream-static join."""
    return verify(citations, pages, use_overlap=use_overlap, scorer=scorer)


def fresh_pages(fetches: DataFrame) -> DataFrame:
    """The first fetch of each URL within the cache's 24 hours; state older than the watermark goes."""
    keyed = fetches.withColumn("norm_url", normalized(F.col("url")))
    return keyed.withWatermark("fetched_at", f"{K.CACHE_HOURS} hours").dropDuplicatesWithinWatermark(["norm_url"])


def pass_rates(verdicts: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``start, total, supported, pass_rate`` of verdicts with a time ``ts``, in windows; later rows than ``late`` don't count."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = verdicts.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == K.SUPPORTED).alias("supported"))
    return counts.select(F.col("w.start").alias("start"), "total", "supported", F.bround(ratio(F.col("supported"), F.col("total")), 4).alias("pass_rate"))
