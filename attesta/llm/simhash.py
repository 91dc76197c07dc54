"""SimHash fingerprints, edited-neighbour likeness and permuted block tables, in DataFrame operations only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import pick, shuffle_partitions, staged
from attesta.llm.quality import words_of

SHINGLE = 5
LANES = 0x0000000100000001
#: Fingerprints of a bucket that are compared with each other in one row.
BUCKET = 512


def terms(text: Column, words: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all word shingles in order (a shorter text is one term, a text without words none)."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - shingle + 1), lambda i: F.xxhash64(*[F.get(words, i - 1 + k) for k in range(shingle)]))
    return F.when(n >= shingle, many).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def votes(h: Column) -> list[Column]:
    """32 sums that count the set bits of all 64 places, two 32-bit counters to a sum."""
    return [F.coalesce(F.sum(F.shiftrightunsigned(h, g).bitwiseAND(F.lit(LANES))), F.lit(0)).alias(f"v{g}") for g in range(32)]


def signed_bits(n: Column) -> Column:
    """The fingerprint: each bit is set where more weight voted for it than against it."""
    bits = F.lit(0).cast("long")
    for g in range(32):
        low = F.col(f"v{g}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"v{g}"), 32)
        bits = bits.bitwiseOR(F.when(2 * low > n, F.lit(1 << g)).otherwise(F.lit(0).cast("long")))
        bits = bits.bitwiseOR(F.when(2 * high > n, F.shiftleft(F.lit(1).cast("long"), g + 32)).otherwise(F.lit(0).cast("long")))
    return bits


def as_string(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for an id and a text; a null text is an empty one."""
    rk = F.substring(F.unhex(F.sha2(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))), 256)), 1, 16)
    return F.coalesce(rk, F.unhex(F.lit("")))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return d.withColumn("rk", row_key(F.col("doc_id"), F.col("text")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint`` (long) of each row. Term weights are term frequencies: each occurrence votes.

    Equal texts have equal fingerprints; a null, empty or wordless text has fingerprint 0. Rows equal in id and text
    come out once for each.
    """
    d = _rows(docs, id_col, text_col).withColumn("w", words_of(F.col("text")))
    h = d.select("rk", "doc_id", F.posexplode_outer(terms(F.col("text"), F.col("w"), shingle)).alias("i", "h"))
    copies = F.count(F.when(F.coalesce("i", F.lit(0)) == 0, 1)).alias("copies")
    sums = h.groupBy("rk", "doc_id").agg(F.count("h").alias("n"), copies, *votes(F.col("h")))
    return sums.select("doc_id", signed_bits(F.col("n")).alias("fingerprint"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def successors(keys: DataFrame) -> DataFrame:
    """``rk, next_rk``: the next row in order of (doc_id, rk), the first one after the last.

    Keys are range-partitioned and frozen; each range knows its successor within itself, and the driver sees one key of
    each range only.
    """
    spark = keys.sparkSession
    ranged = keys.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_first("doc_id"), "rk").withColumn("pid", F.spark_partition_id())
    frozen = staged(ranged, "simhash-order")
    order = [F.asc_nulls_first("doc_id"), F.asc("rk")]
    firsts = frozen.groupBy("pid").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "rk")).alias("m")).orderBy("pid").collect()  # a row for each range
    follow = [(r["pid"], bytes(firsts[(i + 1) % len(firsts)]["m"]["rk"])) for i, r in enumerate(firsts)]
    after = spark.createDataFrame(follow, "pid int, first binary")
    inside = frozen.withColumn("n", F.lead("rk").over(Window.partitionBy("pid").orderBy(*order)))
    return inside.join(F.broadcast(after), "pid").select("rk", F.coalesce("n", "first").alias("next_rk"))  # a row for each range


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Each text's fingerprint beside those of an edited copy and of the next document.

    The edit replaces the last floor(n/4) code points by the first as many (or all) of the next document in ascending id
    (nulls first, then by text hash among equal ids; the last is followed by the first). Rows equal in id and text count
    as one when "next" is found and come out once for each. Null texts are empty. One document follows itself.
    """
    rows = _rows(docs, id_col, text_col)
    texts = rows.groupBy("rk").agg(F.first(F.struct("doc_id", "text")).alias("d"), F.count("*").alias("copies")).where("copies > 0").select("rk", "d.doc_id", "d.text", "copies")
    # both joins below read all of these columns up to the shuffle, so that Spark shuffles the texts once
    keys = rows.groupBy("rk").agg(F.first("doc_id").alias("doc_id"), F.max(F.floor(F.length("text") / 4)).cast("int").alias("k"))
    order = successors(keys.select("doc_id", "rk"))
    asks = order.join(keys.select("rk", "k"), "rk")
    given = texts.join(asks.select(F.col("rk").alias("asker"), F.col("next_rk").alias("rk"), "k").hint("shuffle_hash"), "rk").select(F.col("asker").alias("rk"), F.expr("substring(text, 1, k)").alias("head"))
    n = F.length("text")
    both = texts.join(given.hint("shuffle_hash"), "rk").withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), "head"))
    both = both.withColumn("w", words_of(F.col("text"))).withColumn("e", words_of(F.col("edited")))
    sides = F.concat(F.transform(terms(F.col("text"), F.col("w"), shingle), lambda h: F.struct(F.lit(0).alias("side"), h.alias("h"))), F.transform(terms(F.col("edited"), F.col("e"), shingle), lambda h: F.struct(F.lit(1).alias("side"), h.alias("h"))))
    # all of a row's own values are made below the generator, not again for each term
    wide = both.select("rk", "doc_id", "copies", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), sides.alias("terms"))
    h = wide.select("rk", "doc_id", "copies", "n_chars", "sha", F.explode_outer("terms").alias("x"))
    one = ["rk", "doc_id", "copies", "n_chars", "sha"]
    sums = h.groupBy(*one, F.coalesce("x.side", F.lit(0)).alias("side")).agg(F.count("x.h").alias("n"), *votes(F.col("x.h")))
    fps = sums.select(*one, "side", signed_bits(F.col("n")).alias("fp"))
    fps = fps.groupBy(*one).agg(F.coalesce(F.max(F.when(F.col("side") == 0, F.col("fp"))), F.lit(0)).alias("fp"), F.coalesce(F.max(F.when(F.col("side") == 1, F.col("fp"))), F.lit(0)).alias("efp"))
    fps = staged(fps, "simhash-fingerprints")
    nexts = order.join(fps.select(F.col("rk").alias("next_rk"), F.col("fp").alias("nfp")), "next_rk").select("rk", "nfp")
    out = fps.join(nexts, "rk").select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")


def _tables(radius: int, blocks: int) -> list[int]:
    """Masks of the block tables: two fingerprints within the radius agree on the bits of one mask at least."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]


def _cells(each: DataFrame, masks: list[int], *payload: str) -> DataFrame:
    """``t, key, x, y, p, q``: for each table, key and pair of parts of its bucket, the fingerprints of both parts (structs
    of ``fp`` and the payload). A bucket of more than ``BUCKET`` is dealt into parts."""
    keyed = each.select("fp", *payload, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n_")).where("n_ > 1")
    met = keyed.join(shared, ["t", "key"]).withColumn("parts", F.ceil(F.col("n_") / BUCKET).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))
    side = lambda c: F.collect_list(F.when(F.col("part") == F.col(c), F.struct("fp", *payload)))  # noqa: E731  2 * BUCKET or so at most
    return met.groupBy("t", "key", "x", "y").agg(side("x").alias("p"), side("y").alias("q"))


def _meets(a: Column, b: Column, masks: list[int], radius: int) -> Column:
    """Whether two different fingerprints are within the radius, and this table ``t`` is the first in which they meet."""
    x = a["fp"].bitwiseXOR(b["fp"])
    first = F.array_position(F.array(*[(x.bitwiseAND(F.lit(m).cast("long"))) == 0 for m in masks]), F.lit(True)) - 1
    return (F.bit_count(x) <= radius) & (x != 0) & (first == F.col("t"))


def within(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs of different fingerprints (long column ``fingerprint``) at Hamming distance ``radius`` or less.

    The 64 bits are cut into ``blocks``; two fingerprints within the radius agree on some ``blocks - radius`` of them, so
    there is a table for each such choice, keyed by the bits of the chosen blocks. A pair is taken from the first table
    in which it meets. Works on distinct fingerprints, so copies add nothing; nulls have none. Returns ``a, b, distance``
    with a < b; ``neighbours`` counts without a list of pairs.
    """
    masks = _tables(radius, blocks)
    cells = _cells(fps.select(F.col("fingerprint").alias("fp")).where("fp is not null").distinct(), masks)
    ordered = F.col("x") < F.col("y")
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("q", lambda b: (ordered | (a["fp"] < b["fp"])) & _meets(a, b, masks, radius)), lambda b: F.struct(F.least(a["fp"], b["fp"]).alias("a"), F.greatest(a["fp"], b["fp"]).alias("b")))))
    return cells.select(F.inline(pairs)).select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int").alias("distance"))


def neighbours(docs: DataFrame, radius: int = 3, blocks: int = 6, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, n_within, least_id`` of each row: how many other rows' fingerprints lie within the radius,
    and the least id among those and its own. Every row is searched for; equal fingerprints count too.

    Distinct fingerprints carry their number of rows and least id through the block tables, and each bucket sums what
    every fingerprint of it finds there, so no pair leaves its bucket.
    """
    masks = _tables(radius, blocks)
    fps = staged(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash-searched")
    each = staged(fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "simhash-distinct")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("least"))
    add = lambda s, b: F.struct((s["n"] + b["n"]).alias("n"), F.least(s["least"], b["least"]).alias("least"))

    def found(side: str, other: str) -> Column:
        some = F.transform(side, lambda a: F.struct(a["fp"].alias("fp"), F.aggregate(F.filter(other, lambda b: _meets(a, b, masks, radius)), start, add).alias("s")))
        return F.filter(some, lambda r: r["s"]["n"] > 0)

    none = F.array().cast("array<struct<fp:bigint,s:struct<n:bigint,least:bigint>>>")
    sums = _cells(each, masks, "n", "least").select(F.inline(F.concat(found("p", "q"), F.when(F.col("x") < F.col("y"), found("q", "p")).otherwise(none))))
    others = sums.groupBy("fp").agg(F.sum("s.n").alias("more"), F.min("s.least").alias("near"))
    groups = each.join(others, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_within"), F.least("least", "near").alias("least_id"))
    groups = staged(groups, "simhash-groups")  # so the join is of two plain shuffles, whose skewed parts Spark splits
    return fps.join(groups, fps["fingerprint"] == groups["fp"]).select("doc_id", as_string(F.col("fingerprint")).alias("fingerprint"), "n_within", "least_id")
