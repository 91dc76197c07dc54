"""Claim documents: markdown with citation markers, or structured JSON, to rows of citations and dropped markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.text import strip
from attesta.functions.urls import anchored, looks_like_path, url_from_line

CITATION = "doc_id string, seq int, citation_id string, url string, claim string, source_text string, excerpt string"
_ITEM = "struct<id:string,claim:string,citation:string,source_text:string,excerpt:string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` (the file), ``base`` (its folder), ``body`` and ``format`` of every file under a path, read whole."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("body"))
    return raw.withColumn("base", F.regexp_replace(F.regexp_replace("doc_id", "^file:", ""), "/[^/]*$", "")).withColumn("format", sniffed(F.col("body")))


def sniffed(body: Column) -> Column:
    """``json`` for text that starts like JSON and parses; else ``markdown``."""
    looks = body.rlike(r"(?U)^\s*[\[{]")
    return F.when(looks & F.try_parse_json(body).isNotNull(), F.lit("json")).otherwise(F.lit("markdown"))


def split_sources(body: Column, keep_tail: bool = False) -> tuple[Column, Column]:
    """(text without its sources section, that section) as columns.

    The section runs from the first heading "sources" or "references" to the next heading of its level or above. What
    follows the section isn't part of the text, unless ``keep_tail``.
    """
    heading = F.regexp_extract(body, f"({K.SOURCES_HEADING})", 1)
    level = F.length(F.regexp_extract(body, K.SOURCES_HEADING, 1))
    at = F.regexp_instr(body, F.lit(K.SOURCES_HEADING))
    rest = F.substring(body, at + F.length(heading), F.length(body))
    stop = F.regexp_instr(rest, F.concat(F.lit(r"(?m)^\s{0,3}#{1,"), F.greatest(level, F.lit(1)).cast("string"), F.lit(r"}\s+\S")))
    section = F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest)
    before = F.regexp_replace(F.substring(body, F.lit(1), F.greatest(at - 1, F.lit(0))), r"(?U)\s+$", "")
    if keep_tail:
        before = F.when(stop > 0, F.concat(before, F.lit("\n\n"), F.substring(rest, stop, F.length(rest)))).otherwise(before)
    return F.when(at > 0, before).otherwise(body), F.when(at > 0, section).otherwise(F.lit(""))


def source_map(sections: DataFrame) -> DataFrame:
    """``doc_id, marker, url`` of each document's ``section``: definitions first, the last of equal ones; then numbered
    items, the first of equal ones."""
    definitions = F.arrays_zip(F.regexp_extract_all("section", F.lit(K.REF_DEFINITION), F.lit(1)).alias("m"), F.regexp_extract_all("section", F.lit(K.REF_DEFINITION), F.lit(2)).alias("v"))
    items = F.arrays_zip(F.regexp_extract_all("section", F.lit(K.NUMBERED_ITEM), F.lit(1)).alias("m"), F.regexp_extract_all("section", F.lit(K.NUMBERED_ITEM), F.lit(2)).alias("v"))
    a = sections.select("doc_id", F.posexplode(definitions).alias("i", "x")).select("doc_id", strip(F.col("x.m")).alias("marker"), strip(F.col("x.v")).alias("url"), F.struct(F.lit(0).alias("k"), (-F.col("i")).alias("i")).alias("rank"))
    b = sections.select("doc_id", F.posexplode(items).alias("i", "x")).select("doc_id", F.col("x.m").alias("marker"), url_from_line(strip(F.col("x.v"))).alias("url"), F.struct(F.lit(1).alias("k"), F.col("i").alias("i")).alias("rank"))
    return a.unionByName(b).where("url is not null").groupBy("doc_id", "marker").agg(F.min_by("url", "rank").alias("url"))


def claim_unit(paragraph: Column, offset: Column) -> Column:
    """The sentence that holds an offset (from 0); the whole paragraph if the offset is in none or the sentence blank."""
    head = F.substring(paragraph, F.lit(1), offset)
    tail = F.substring(paragraph, offset + 1, F.length(paragraph))
    # a boundary that touches the offset belongs to neither side
    before = F.element_at(F.split(head, K.SENTENCE_END, -1), -1)
    after = F.get(F.split(F.concat(F.substring(head, -1, 1), tail), K.SENTENCE_END, -1), F.lit(0))
    unit = strip(F.concat(before, F.when(offset > 0, F.substring(after, F.lit(2), F.length(after))).otherwise(after)))
    return F.when(unit == "", strip(paragraph)).otherwise(unit)


def marker_events(bodies: DataFrame) -> DataFrame:
    """``doc_id, para, pos, marker, target, claim`` of every marker in ``body``; ``target`` is null for ``[n]``.

    Paragraphs are exploded, so one long document is no single row of work after that. Offsets come from the lengths of
    what lies between matches.
    """
    paras = bodies.select("doc_id", F.posexplode(F.split("body", r"\n\s*\n", -1)).alias("para", "p")).select("doc_id", "para", strip(F.col("p")).alias("p")).where("p <> ''")

    def hits(pattern: str, groups: tuple[int, ...]) -> DataFrame:
        found = F.regexp_extract_all("p", F.lit(f"({pattern})"), F.lit(1))
        gaps = F.split("p", pattern, -1)
        starts = F.transform(found, lambda _, i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda s, g: s + F.length(g)) + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda s, m: s + F.length(m)))
        parts = [F.regexp_extract_all("p", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
        zipped = F.arrays_zip(starts.alias("pos"), *parts)
        return paras.select("doc_id", "para", "p", F.explode(zipped).alias("x")).select("doc_id", "para", "p", "x.*")

    numbers = hits(K.NUMERIC_MARKER, (1,)).select("doc_id", "para", "p", "pos", F.col("g1").alias("marker"), F.lit(None).cast("string").alias("target"))
    links = hits(K.INLINE_LINK, (1, 2)).where("not (g2 like '#%' or lower(g2) like 'mailto:%')").select("doc_id", "para", "p", "pos", strip(F.col("g1")).alias("marker"), F.col("g2").alias("target"))
    return numbers.unionByName(links).select("doc_id", "para", "pos", "marker", "target", claim_unit(F.col("p"), F.col("pos")).alias("claim"))


def extract(documents: DataFrame, url_map: DataFrame | None = None, keep_tail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(citations, dropped markers) of markdown ``doc_id, body`` rows.

    ``url_map`` (doc_id, marker, url) overrides what a document's own sources say. A numeric marker without a URL is
    dropped, with up to 160 characters of its sentence. Null bodies have no markers.
    """
    body, section = split_sources(F.coalesce("body", F.lit("")), keep_tail)
    parts = documents.select("doc_id", body.alias("body"), section.alias("section"))
    known = source_map(parts).withColumn("rank", F.lit(1))
    if url_map is not None:
        known = known.unionByName(url_map.select("doc_id", F.col("marker").cast("string").alias("marker"), "url", F.lit(0).alias("rank"))).groupBy("doc_id", "marker").agg(F.min_by("url", "rank").alias("url"))
    events = marker_events(parts).withColumn("key", F.when(F.col("target").isNull(), F.col("marker")))
    met = events.join(known.select(F.col("doc_id").alias("d"), F.col("marker").alias("m"), "url"), (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("m")), "left").withColumn("url", F.coalesce("target", "url"))
    order = Window.partitionBy("doc_id").orderBy("para", "pos")
    citations = met.where("url is not null").select("doc_id", (F.row_number().over(order) - 1).alias("seq"), F.col("marker").alias("citation_id"), "url", "claim", F.lit(None).cast("string").alias("source_text"), F.lit(None).cast("string").alias("excerpt"))
    dropped = met.where("url is null").select("doc_id", "para", "pos", F.concat(F.lit("["), F.col("marker"), F.lit("]")).alias("marker"), F.lit("no URL for this marker").alias("reason"), F.substring("claim", 1, K.DROP_CONTEXT_CHARS).alias("context"))
    return citations, dropped


def citations_from_json(documents: DataFrame, strict: bool = True) -> DataFrame:
    """Citations of JSON ``doc_id, body`` rows: a list of items, or an object with ``citations`` and ``sources``.

    An item's citation is a URL or path as it is, else a key of ``sources``. With ``strict``, wrong shapes raise;
    without, ``problem`` says what is wrong and the row stays.
    """
    listed = F.from_json("body", f"array<{_ITEM}>")
    wrapped = F.from_json("body", f"struct<citations:array<{_ITEM}>,sources:map<string,string>,url_map:map<string,string>>")
    is_list = F.startswith(strip(F.col("body")), F.lit("["))
    d = documents.select("doc_id", is_list.alias("is_list"), listed.alias("a"), wrapped.alias("o"), F.col("body").rlike(r'"citations"\s*:').alias("has_key"))
    d = d.select("doc_id", "is_list", "has_key", F.when(F.col("is_list"), F.col("a")).otherwise(F.col("o.citations")).alias("items"), F.coalesce("o.sources", "o.url_map").alias("sources"))
    x = d.select("doc_id", "sources", F.posexplode("items").alias("seq", "i"))
    ref = strip(F.col("i.citation"))
    number = F.concat(F.lit("citation #"), (F.col("seq") + 1).cast("string"))
    found = F.when(looks_like_path(ref), ref).otherwise(F.element_at("sources", ref))
    problem = (
        F.when(F.col("i.claim").isNull() | F.col("i.citation").isNull(), F.concat(number, F.lit(": needs a claim and a citation")))
        .when(F.contains(ref, F.lit("{{")) | F.contains(ref, F.lit("}}")), F.concat(number, F.lit(": unresolved placeholder")))
        .when(found.isNull(), F.concat(number, F.lit(": neither a URL, nor a path, nor a known source")))
    )
    excerpt = strip(F.col("i.excerpt"))
    rows = x.select(
        "doc_id", "seq", F.coalesce(F.when(F.col("i.id") != "", F.col("i.id")), F.concat(F.lit("c"), (F.col("seq") + 1).cast("string"))).alias("citation_id"), found.alias("url"), F.col("i.claim").alias("claim"),
        F.col("i.source_text").alias("source_text"), F.when(excerpt != "", excerpt).alias("excerpt"), problem.alias("problem"),
    )
    if not strict:
        return rows
    return rows.withColumn("claim", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))).otherwise(F.col("claim"))).drop("problem")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(citations, dropped markers) of all files under a path; bare relative URLs are taken from the file's folder."""
    docs = read_documents(spark, path)
    citations, dropped = extract(docs.where("format = 'markdown'"))
    both = citations.unionByName(citations_from_json(docs.where("format = 'json'")))
    folders = docs.select(F.col("doc_id").alias("d"), "base")
    placed = both.join(folders, F.col("doc_id") == F.col("d")).withColumn("url", anchored(F.col("url"), F.col("base"))).drop("d", "base")
    return placed, dropped
