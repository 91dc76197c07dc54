"""Reports: the aggregate of a run, as a row, as JSON, as text for people; and the sinks of evaluation results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.operators import evaluation as V
from attesta.operators.verdicts import rollup

SYMBOLS = {K.SUPPORTED: "✅", K.UNSUPPORTED: "❌", K.UNREACHABLE: "⛔", K.PAYWALLED: "🔒", K.AMBIGUOUS: "❓"}


def verdict_json(verdicts: DataFrame) -> DataFrame:
    """One JSON ``value`` for each verdict: what a large run writes, without gathering it."""
    return verdicts.select(F.to_json(F.struct("citation_id", "url", "status", "tier_reached", "score", "evidence", "notes")).alias("value"))


def write_report(verdicts: DataFrame, path: str) -> None:
    """Verdicts as JSON lines under ``path/verdicts`` and the aggregate under ``path/summary``."""
    verdict_json(verdicts).write.mode("overwrite").text(f"{path}/verdicts")
    rollup(verdicts).write.mode("overwrite").json(f"{path}/summary")


def document_reports(verdicts: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """A report for each document, its verdicts in order, as one JSON ``report``. Grouping is by document."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("citation_id", "url", "status", "tier_reached", "score", "evidence", "notes").alias("v")))), lambda x: x["v"])
    d = verdicts.groupBy("doc_id").agg(ordered.alias("verdicts"), F.max("tier_reached").alias("tiers_reached"))
    d = d.join(rollup(verdicts, "doc_id"), "doc_id")
    if dropped is not None:
        lost = dropped.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para", "pos", "marker", "reason", "context"))), lambda x: F.struct(x["marker"].alias("marker"), x["reason"].alias("reason"), x["context"].alias("context"))).alias("dropped_markers"))
        d = d.join(lost, "doc_id", "left")
    fields = [c for c in d.columns if c != "doc_id"]
    return d.select("doc_id", F.to_json(F.struct(*fields)).alias("report"))


#: Rows that a report on the driver may hold.
MOST_ROWS = 100_000


def _few(rows: DataFrame) -> list[dict]:
    got = rows.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write them as a table")
    return [r.asDict(recursive=True) for r in got]


def report(verdicts: DataFrame, dropped: DataFrame | None = None, nli_active: bool = False) -> dict:
    """A run's report as a dict, for small runs: what the command line and the service functions return.

    More than ``MOST_ROWS`` verdicts or dropped markers raise: ``write_report`` and ``document_reports`` are for those.
    """
    head = rollup(verdicts).first().asDict()
    rows = _few(verdicts.orderBy("doc_id", "seq"))
    lost = _few(dropped.orderBy("doc_id", "para", "pos").select("marker", "reason", "context")) if dropped is not None else []
    return head | {"verdicts": [{k: v for k, v in r.items() if k not in ("doc_id", "seq", "claim")} for r in rows], "dropped_markers": lost, "nli_active": nli_active, "tiers_reached": max([r["tier_reached"] for r in rows], default=0)}


def rendered(result: dict, threshold: float = 0.8, strict: bool = False) -> str:
    """The report for people, in Markdown."""
    lines = [f"# Verification report: {result['total']} citation(s)", f"Entailment tier: {'on' if result['nli_active'] else 'off'}", ""]
    for v in result["verdicts"]:
        score = f", score {v['score']:.3f}" if isinstance(v["score"], (int, float)) else ""
        lines.append(f"- {SYMBOLS.get(v['status'], '•')} {_label(v['status'], strict)}: citation {v['citation_id']} of <{v['url']}>, tier {v['tier_reached']}{score}")
        lines += [f"  - evidence: {v['evidence']}"] if v["evidence"] else []
        lines += [f"  - note: {n}" for n in v["notes"]]
    if result["dropped_markers"]:
        lines += ["", f"## Claims left out: {len(result['dropped_markers'])} marker(s) lead to no source", ""]
        lines += [f"- {d['marker']}: {d['reason']}" for d in result["dropped_markers"]]
    count = lambda s: sum(v["status"] == s for v in result["verdicts"])
    lines += ["", "## Summary", "", f"- total: {result['total']}", *[f"- {s}: {count(s)}" for s in K.VERDICTS], f"- unverifiable: {result['unverifiable']}", f"- pass_rate: {result['pass_rate']:.4f}"]
    met = result["pass_rate"] >= threshold
    return "\n".join([*lines, "", f"**Decision: {'PASS' if met else 'FAIL'}** (pass_rate {result['pass_rate']:.4f} {'>=' if met else '<'} threshold {threshold:g})"])


def _label(status: str, strict: bool) -> str:
    if status == K.SUPPORTED:
        return "PASS"
    if status == K.UNSUPPORTED:
        return "FAIL"
    return "FAIL (strict)" if strict and status == K.AMBIGUOUS else "UNVERIFIABLE"


def exit_status(result: dict, threshold: float = 0.8, strict: bool = False) -> int:
    bad = strict and any(v["status"] in (K.AMBIGUOUS, K.UNSUPPORTED) for v in result["verdicts"])
    return int(result["pass_rate"] < threshold or bad)


def _table(d: DataFrame) -> list[dict]:
    return [{k: None if v != v else v for k, v in r.items()} for r in _few(d)]  # JSON has no NaN


def evaluation_summary(records: DataFrame, cases: DataFrame, generated_utc: str, set_name: str, nli: bool) -> dict:
    """The aggregates of an evaluation run, each a few rows whatever the size of the set."""
    overall = V.agreement(records).first()
    return {
        "generated_utc": generated_utc, "set": set_name, "nli": nli, "total": overall["total"], "matched": overall["correct"], "agreement_pct": round(100 * overall["agreement"], 2),
        "confusion_matrix": _table(V.confusion_matrix(records)), "per_category_recall": _table(V.category_recall(records)), "per_status_pr": _table(V.status_precision_recall(records)),
        "uncertainty": _table(V.uncertainty(records, cases)), "cluster_bootstrap": _table(V.uncertainty_block(records, cases).where("part = 'clusters'")), "by_labeler_confidence": _table(V.confidence_breakdown(records, cases)), "safety": _table(V.safety_rate(records, "negation-flip", "entity-swap")),
    }


def evaluation_payload(records: DataFrame, cases: DataFrame, generated_utc: str, set_name: str, nli: bool) -> str:
    """An evaluation run's result as JSON text: the aggregates and the records of the set.

    A set of more than ``MOST_ROWS`` records raises: ``write_evaluation`` is for those.
    """
    body = evaluation_summary(records, cases, generated_utc, set_name, nli)
    return json.dumps(body | {"records": _table(V.graded(records))}, ensure_ascii=False, indent=2)


def write_evaluation(records: DataFrame, cases: DataFrame, path: str, generated_utc: str, set_name: str, nli: bool) -> None:
    """An evaluation run's aggregates as one JSON line under ``path/summary``, its records as JSON lines under
    ``path/records``, for sets of any size: no record passes the driver."""
    d = V.graded(records)
    d = d.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in d.dtypes if kind in ("double", "float")})  # JSON has no NaN
    d.select(F.to_json(F.struct(*d.columns)).alias("value")).write.mode("overwrite").text(f"{path}/records")
    body = json.dumps(evaluation_summary(records, cases, generated_utc, set_name, nli), ensure_ascii=False)
    records.sparkSession.createDataFrame([(body,)], "value string").write.mode("overwrite").text(f"{path}/summary")


