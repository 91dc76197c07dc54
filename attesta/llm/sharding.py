"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import pick, shuffle_partitions, staged, text_key

GROUPS = "key binary, copies long, load long, part int, bin int, base long"


def _schedule(n_shards: int):
    """Packs one size range: groups arrive largest first and go to the least loaded of ``n_shards`` bins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        heap = [(0, b) for b in range(n_shards)]
        rows = [0] * n_shards
        for batch in batches:
            bins, bases = [], []
            for load, copies in zip(batch["load"].tolist(), batch["copies"].tolist(), strict=True):
                held, b = heap[0]
                heapq.heapreplace(heap, (held + load, b))
                bins.append(b)
                bases.append(rows[b])
                rows[b] += copies
            yield batch.assign(part=part, bin=bins, base=bases)

    return run


def lpt_shards(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """Deals documents to ``n_shards`` shards of nearly equal bytes; equal texts stay together.

    Scheduling is longest-processing-time in two levels, so that neither a task nor the driver holds all groups:
    groups (equal texts) are range-partitioned by descending size; each range is packed by a heap into ``n_shards``
    bins; then the bins of all ranges (partitions x shards of them, the driver's only data) are scheduled the same way.
    A group's copies are numbered in ``salts`` pieces (four for each shuffle partition by default, so that they follow the
    cluster's size), so one group with a third of all rows is no single task; the group itself is one unit and fills a shard
    alone if it exceeds a shard's share. Where a range holds far more groups than shards, its bins are nearly equal, so the
    shards differ by little more than the largest group, as those of one global schedule would.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. A null text has size 1 and CRC 0 and groups
    with other nulls, apart from empty texts. Null ids are allowed; repeated rows each get a slot. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    salts = salts or 4 * shuffle_partitions(spark)
    d = pick(docs, doc_id=id_col, text=text_col)
    rows = d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        text_key(F.col("text")).alias("key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    groups = rows.groupBy("key").agg(F.count("*").alias("copies"), F.max("size").alias("size")).select("key", "copies", (F.col("copies") * F.col("size")).alias("load"))
    ranged = groups.repartitionByRange(shuffle_partitions(spark), F.desc("load"), "key").sortWithinPartitions(F.desc("load"), "key")
    packed = staged(ranged.mapInPandas(_schedule(n_shards), GROUPS), "lpt-groups")

    bins = packed.groupBy("part", "bin").agg(F.sum("load").alias("load"), F.sum("copies").alias("copies")).collect()  # partitions x shards rows
    heap, held, place = [(0, s) for s in range(n_shards)], [0] * n_shards, []
    for b in sorted(bins, key=lambda r: (-r["load"], r["part"], r["bin"])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + b["load"], shard))
        place.append((b["part"], b["bin"], shard, held[shard]))
        held[shard] += b["copies"]
    places = spark.createDataFrame(place, "part int, bin int, shard int, ahead long")

    # at most partitions x shards rows, whatever the data
    homes = packed.join(F.broadcast(places), ["part", "bin"]).select("key", "shard", (F.col("ahead") + F.col("base")).alias("base"))
    pieces = rows.groupBy("key", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("before", before).join(homes, "key").select("key", "salt", "shard", (F.col("base") + F.col("before")).alias("base"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "salt").orderBy("doc_id")) - 1)
    return ranked.join(pieces, ["key", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
