"""Corpus pipeline: quality rules, near-dedup, substring dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of ``documents``; the
last returns encoded rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import common, mixing, neardup, pieces, quality, substring
from attesta.llm.queries import PIECE_MODEL, TARGETS, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the quality rules go; nulls and texts under fifty words are among them."""
    return quality.keep_good(docs).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the document of least id stays, nulls last, and rows equal in id and text count as
    one."""
    return neardup.deduplicated(docs, 5, 80).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document keeps its row even if all its words repeat elsewhere; ``n_chars`` follows the text."""
    kept = substring.drop_repeated_windows(docs, 35, layout=True, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", F.length("kept_text").cast("long").alias("n_chars"))


def to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document is lost: those of languages below their target come more than once. Rows equal in id and text share a rate,
    a text without words has the prior's."""
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"), TARGETS, keep_all=True).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row; a null or empty text has no pieces."""
    return pieces.encode(docs, PIECE_MODEL).select("doc_id", "ids", "n_pieces", "ids_sha256", "round_trip")


STAGES = [
    ("quality rules", good_documents),
    ("MinHash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("mixing to target weights", to_targets),
    ("SentencePiece encoding", encoded),
]
#: Shingle links, mixing rates and the encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Each stage's rows are written to the shared folder, as the next one reads them several
    times; what it needed on the way, and its input, is deleted then.

    A document with a null id is treated like any other; null and empty texts fail the quality rules, so they go there.
    Ties in near-duplicates go to the least id. An empty table gives no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.delete(spark, before)
        before = common.last_staged()
    return STAGES[-1][1](spark, docs, sf_dir)
