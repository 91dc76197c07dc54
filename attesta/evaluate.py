"""Evaluation from the command line: run a case set, compare runs, split it, ablate tiers, summarise.

Each command reads JSON case sets (``sources.cases.CASE``) and writes JSON with the aggregates; records of large sets go to
``--records`` as a table and never through the driver.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import normal_status
from attesta.operators import evaluation as E
from attesta.operators.entailment import Scorer, lexical_scorer
from attesta.operators.models import ModelError
from attesta.plans import report as R
from attesta.plans.verify import verify
from attesta.service import chosen_scorer
from attesta.sources.cases import latest_run, read_cases
from attesta.sources.documents import CITATION
from attesta.sources.pages import described

#: Tier settings of an ablation: name -> (overlap, entailment).
CONFIGS = {"tier1": (False, False), "tier1+2": (True, False), "tier1+2+3": (True, True)}


def case_records(cases: DataFrame, pages: DataFrame, *, use_overlap: bool = True, scorer: Scorer | None = None) -> DataFrame:
    """A record (``sources.cases.RECORD``) for each case. A case that gets no verdict is an error record, not a lost row."""
    given = cases.select(F.col("id").alias("doc_id"), F.lit(0).alias("seq"), F.col("id").alias("citation_id"), "url", "claim", F.lit(None).cast("string").alias("source_text"), F.lit(None).cast("string").alias("excerpt"))
    assert given.columns == [c.split()[0] for c in CITATION.split(", ")]
    said = verify(given, described(pages), use_overlap=use_overlap, scorer=scorer).select(F.col("doc_id").alias("id"), "status", "score", "tier_reached", "evidence", "notes")
    predicted = F.coalesce(normal_status(F.col("status")), F.lit("error: no verdict"))
    d = cases.select("id", "category", "expected_status").join(said, "id", "left")
    return d.select("id", "category", F.col("expected_status").alias("expected"), predicted.alias("predicted"), "score", F.coalesce("tier_reached", F.lit(0)).alias("tier_reached"), F.coalesce(predicted == F.col("expected_status"), F.lit(False)).alias("match"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))


def _rows(d: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in d.collect()]  # aggregates: a few rows


def _written(body: dict | str, out: str | None) -> int:
    text = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False, indent=2)
    if out:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        Path(out).write_text(text + "\n", encoding="utf-8")
    else:
        print(text)
    return 0


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    cases, pages = read_cases(spark, a.set), spark.read.parquet(a.pages)
    records = case_records(cases, pages, scorer=chosen_scorer(a.nli, a.nli_model)).cache()
    if a.records:
        records.write.mode("overwrite").parquet(a.records)
    about = (records, cases, datetime.now(UTC).isoformat(timespec="seconds"), a.set, bool(a.nli))
    whole = not a.records or records.count() <= R.MOST_ROWS  # else the records are in their table only
    body = json.loads(R.evaluation_payload(*about)) if whole else R.evaluation_summary(*about)
    if a.compare:
        before = latest_run(spark, a.compare)
        body["compared"] = {"mcnemar": _rows(E.mcnemar_test(records, before)), "changes": _rows(E.run_difference(records, before)), "families": _rows(E.family_deltas(records, before))}
    return _written(body, a.out)


def split(spark: SparkSession, a: argparse.Namespace) -> int:
    cases = read_cases(spark, a.set).cache()
    sides = (E.split_by_url(cases, a.seed) if not a.stratified else E.stratified_split(cases, str(a.seed))).cache()
    problems = _rows(E.partition_problems(sides, cases))
    body = {"seed": a.seed, "summary": _rows(E.partition_summary(sides, cases)), "problems": problems, "baselines": _rows(E.bounded_baselines(cases) if a.stratified else E.baselines(cases, seed=a.seed))}
    body |= {s: sorted(r["id"] for r in sides.where(F.col("side") == s).select("id").collect()) for s in ("tune", "heldout")} if not a.stratified else {}
    if a.records:
        sides.write.mode("overwrite").parquet(a.records)
    return _written(body, a.out) or int(bool(problems))


def ablation(spark: SparkSession, a: argparse.Namespace) -> int:
    cases, pages = read_cases(spark, a.set), spark.read.parquet(a.pages)
    scorer = chosen_scorer(True, a.nli_model) if a.nli is not False else lexical_scorer
    runs = None
    for name, (overlap, entail) in CONFIGS.items():
        r = case_records(cases, pages, use_overlap=overlap, scorer=scorer if entail else None).withColumn("config", F.lit(name))
        runs = r if runs is None else runs.unionByName(r)
    if a.records:
        runs.write.mode("overwrite").parquet(a.records)
    return _written({"set": a.set, "configs": _rows(E.ablation(runs, cases).orderBy("config", "tier", "confidence"))}, a.out)


COMMANDS = {"run": run, "split": split, "ablation": ablation}


def main(argv: list[str] | None = None) -> int:
    """Exit status: 0 done, 1 a split that isn't one, 2 wrong input or a model that can't be loaded."""
    ap = argparse.ArgumentParser(prog="attesta.evaluate", description="Evaluate verdicts on labelled cases.")
    ap.add_argument("command", choices=COMMANDS)
    ap.add_argument("--set", required=True, help="JSON list of cases")
    ap.add_argument("--pages", help="Parquet table of pages; needed to run cases")
    ap.add_argument("--out", help="file for the JSON result; standard output without it")
    ap.add_argument("--records", help="folder for the rows, as a table")
    ap.add_argument("--compare", help="folder of earlier results: the last by name is the baseline")
    ap.add_argument("--nli", action=argparse.BooleanOptionalAction, default=None)
    ap.add_argument("--nli-model")
    ap.add_argument("--seed", type=int, default=42)
    ap.add_argument("--stratified", action="store_true", help="split sets of any size, without the driver")
    a = ap.parse_args(argv)
    try:
        if a.command != "split" and not a.pages:
            raise ValueError("--pages is needed")
        return COMMANDS[a.command](SparkSession.builder.getOrCreate(), a)
    except (ModelError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
