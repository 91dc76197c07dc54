"""Evaluation inputs: case sets, saved page texts and run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "id string, category string, expected_status string, labeler_confidence string, url string, claim string, notes string, supported_clauses array<string>, unsupported_clauses array<string>"
RECORD = "id string, category string, expected string, predicted string, score double, tier_reached int, match boolean, evidence string, notes array<string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON lists, in a fixed schema."""
    return spark.read.schema(CASE).json(path, multiLine=True)


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """``slug, text`` of saved ``slug.txt`` files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.txt)?$", 1).alias("slug"), F.col("value").alias("text"))


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The records of the result file that comes last by name."""
    raw = spark.read.schema(f"records array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    return raw.select(F.col("_metadata.file_name").alias("f"), "records").orderBy(F.desc("f")).limit(1).select(F.inline("records"))


def with_text(cases: DataFrame, pool: DataFrame, texts: DataFrame) -> DataFrame:
    """Cases with the ``ok`` flag and ``text`` of their page; a page that is missing leaves nulls."""
    keyed = pool.select("url", "ok", F.regexp_extract("text_path", r"([^/]*?)(?:\.txt)?$", 1).alias("slug"))
    return cases.join(keyed.dropDuplicates(["url"]).join(texts, "slug", "left").drop("slug"), "url", "left")
