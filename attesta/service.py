"""Two calls that take plain values and return a report, and the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.urls import normalized
from attesta.operators.entailment import Scorer, lexical_scorer, model_available
from attesta.operators.models import ModelError, model_name, named_scorer
from attesta.plans.report import exit_status, rendered, report
from attesta.plans.verify import verify
from attesta.sources.documents import citations_from_json, extract, load
from attesta.sources.pages import described, write_cache
from attesta.sources.staging import frozen
from attesta.sources.web import Opener, dispatched, open_url


def verify_citations(spark: SparkSession, citations: list | str, pages: DataFrame, scorer: Scorer | None = None) -> dict:
    """A report on a list of {claim, citation} items (or its JSON text); ``{"error": ...}`` if anything is wrong."""
    try:
        body = citations if isinstance(citations, str) else json.dumps(citations)
        docs = spark.createDataFrame([("call", body)], "doc_id string, body string")
        return report(verify(citations_from_json(docs), described(pages), scorer=scorer), nli_active=scorer is not None)
    except Exception as e:  # noqa: BLE001  a caller gets every failure as data
        return {"error": f"{type(e).__name__}: {e}"}


def verify_markdown(spark: SparkSession, markdown: str, pages: DataFrame, url_map: dict[str, str] | None = None, scorer: Scorer | None = None) -> dict:
    """A report on the citations of a Markdown text."""
    try:
        docs = spark.createDataFrame([("call", markdown)], "doc_id string, body string")
        given = spark.createDataFrame([("call", str(k), v) for k, v in (url_map or {}).items()], "doc_id string, marker string, url string")
        citations, dropped = extract(docs, given)
        return report(verify(citations, described(pages), scorer=scorer), dropped, scorer is not None)
    except Exception as e:  # noqa: BLE001
        return {"error": f"{type(e).__name__}: {e}"}


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="attesta", description="Verify the citations of documents.")
    ap.add_argument("file", help="Markdown with citations, or JSON")
    ap.add_argument("--pages", help="Parquet table with url, html and optionally ok, error, fetched_at; without it pages are fetched")
    ap.add_argument("--json", action="store_true")
    ap.add_argument("--md", metavar="FILE")
    ap.add_argument("--threshold", type=float, default=0.8)
    ap.add_argument("--strict", action="store_true")
    ap.add_argument("--nli", action=argparse.BooleanOptionalAction, default=None, help="the third tier; by default on where its libraries are installed")
    ap.add_argument("--nli-model", metavar="NAME", help=f"a model's name, {LEXICAL!r} for the scorer without a model; else ${K.ENV_MODEL}, else the default")
    ap.add_argument("--cache-dir", metavar="DIR", help=f"the page cache, instead of ${K.ENV_CACHE}")
    return ap


#: The name of the scorer that needs no model.
LEXICAL = "lexical"


def chosen_scorer(nli: bool | None, model: str | None) -> Scorer | None:
    """The scorer that the flags and the environment ask for; a model that can't be loaded raises ``ModelError``."""
    if model is None and (nli is False or (nli is None and not model_available())):
        return None
    name = model_name(model)
    return lexical_scorer if name == LEXICAL else named_scorer(name)


def cited_pages(spark: SparkSession, citations: DataFrame, cache_dir: str | None, opener: Opener = open_url) -> DataFrame:
    """Raw pages of the citations' URLs, fetched or taken from the cache, which gets the new ones. A user's own local files
    are readable from the command line."""
    path = f"{cache_dir}/pages" if cache_dir else None
    cache = None
    if path:
        try:
            cache = spark.read.parquet(path)
        except AnalysisException:  # nothing kept yet
            cache = None
    roots = tuple(r for r in os.environ.get(K.ENV_ROOTS, "").split(os.pathsep) if r)
    raw = frozen(dispatched(citations.select("url"), opener=opener, cache=cache, roots=roots, any_local=True).withColumn("fetched_at", F.current_timestamp()))
    if path:
        write_cache(raw.withColumn("norm_url", normalized(F.col("url"))), path)
    return raw


def main(argv: list[str] | None = None) -> int:
    """Exit status: 0 passed, 1 failed, 2 wrong input or a model that can't be loaded."""
    a = parser().parse_args(argv)
    try:
        scorer = chosen_scorer(a.nli, a.nli_model)  # before anything is read: a wrong name mustn't cost a run
    except ModelError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if scorer is None:
        print("note: the entailment tier is off, so negated claims and exchanged names can't be told", file=sys.stderr)
    spark = SparkSession.builder.getOrCreate()
    try:
        citations, dropped = load(spark, a.file)
        raw = spark.read.parquet(a.pages) if a.pages else cited_pages(spark, citations, a.cache_dir or os.environ.get(K.ENV_CACHE))
        result = report(verify(citations, described(raw), scorer=scorer), dropped, scorer is not None)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 2
    if not result["total"]:
        print("note: no citations found", file=sys.stderr)
    text = rendered(result, a.threshold, a.strict)
    print(json.dumps(result, ensure_ascii=False, indent=2) if a.json else text)
    if a.md:
        with open(a.md, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    for d in result["dropped_markers"]:
        print(f"dropped {d['marker']}: {d['reason']}", file=sys.stderr)
    return exit_status(result, a.threshold, a.strict)


if __name__ == "__main__":
    sys.exit(main())
