"""The verification plan: citations and pages to verdicts, as one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import text as T
from attesta.functions.urls import normalized
from attesta.operators import entailment as E
from attesta.operators import overlap as O
from attesta.operators import verdicts as V

VERDICT = ("doc_id", "seq", "citation_id", "url", "claim", "status", "tier_reached", "score", "evidence", "notes")


def located(citations: DataFrame, pages: DataFrame, versions: tuple[str, ...] = ()) -> DataFrame:
    """Citations with their page (of ``sources.pages.described``); a page that isn't there is unreachable.

    With ``versions``, columns of both, a citation means that version of its page.

    Passages and their terms are made once for each page before the join, whatever cites it. A page cited by very many
    is split by the join's skew handling, as nothing above the join needs a page's rows together.
    """
    prepared = pages.select("norm_url", *versions, "ok", "error", "text", "paywall_detected", "retraction_detected", O.passage_terms(T.segment_passages(F.col("text"))).alias("page_passages"))
    keyed = citations.withColumn("norm_url", normalized(F.col("url")))
    return keyed.join(prepared, ["norm_url", *versions], "left").withColumn("error", F.when(F.col("ok").isNull(), F.lit("page not found")).otherwise(F.col("error")))


def first_tier(rows: DataFrame) -> DataFrame:
    """Reachability only: tier 1."""
    status = V.reachability(F.col("ok"), F.col("paywall_detected"), F.col("retraction_detected"))
    out = rows.withColumn("status", status).withColumn("notes", V.reachability_notes(F.col("status"), F.col("error"), F.col("text")))
    return out.withColumn("tier_reached", F.lit(1)).withColumn("score", F.lit(None).cast("double")).withColumn("evidence", T.clipped(F.coalesce("text", F.lit(""))))


def second_tier(rows: DataFrame) -> DataFrame:
    """Overlap for the reachable: adds ``target``, ``passages`` and ``scored`` for the third tier.

    An excerpt stands for the page. Without one, a page under 80 characters can't be judged and is ambiguous.
    """
    excerpt = T.strip(F.coalesce("excerpt", F.lit("")))
    d = rows.withColumn("excerpt", excerpt).withColumn("reached", F.col("status") == K.SUPPORTED)
    d = d.withColumn("target", F.when(F.col("excerpt") != "", F.col("excerpt")).otherwise(F.coalesce("text", F.lit(""))))
    d = d.withColumn("located", (F.col("excerpt") != "") | (F.length("target") >= K.MIN_PAGE_CHARS))
    d = d.withColumn("scored", F.col("reached") & F.col("located"))
    d = d.withColumn("passages", F.when(F.col("excerpt") != "", O.passage_terms(T.segment_passages(F.col("excerpt")))).otherwise(F.col("page_passages")))
    d = d.withColumn("found", F.when(F.col("scored"), O.compound(F.col("claim"), F.col("passages"))))
    status = F.when(F.col("scored"), O.status_for_score(F.col("found.score"))).when(F.col("reached"), F.lit(K.AMBIGUOUS)).otherwise(F.col("status"))
    source = F.when(F.col("excerpt") != "", F.lit("the given excerpt")).otherwise(F.lit("the page"))
    note = F.when(F.col("scored"), F.array(F.concat(F.format_string("overlap %.3f with ", F.col("found.score")), source))).when(F.col("reached"), F.array(F.lit(f"fewer than {K.MIN_PAGE_CHARS} characters of text: citation not locatable"))).otherwise(F.array().cast("array<string>"))
    evidence = F.when(F.col("scored"), F.col("found.evidence")).when(F.col("reached"), T.clipped(F.col("target"))).otherwise(F.col("evidence"))
    d = d.withColumn("evidence", evidence).withColumn("notes", F.concat("notes", note)).withColumn("score", F.col("found.score"))
    return d.withColumn("tier_reached", F.when(F.col("reached"), F.lit(2)).otherwise(F.lit(1))).withColumn("status", status).drop("found")


def third_tier(rows: DataFrame, scorer: E.Scorer) -> DataFrame:
    """Entailment for rows with passages. Arrays of premises go to the scorer inside the row, so nothing is shuffled."""
    claim = T.clean_claim(F.col("claim"))
    d = rows.withColumn("clean", claim).withColumn("eligible", F.col("scored") & (F.size("passages") > 0))
    top = F.transform(O.ranked(F.col("clean"), F.col("passages")), lambda p: p["passage"])
    d = d.withColumn("span", F.when(F.col("eligible"), T.verbatim_span(F.col("clean"), F.col("target"))))
    none = F.array().cast("array<string>")
    d = d.withColumn("premises", F.when(F.col("eligible"), E.premises(F.col("clean"), top, F.col("target"), F.col("span"))).otherwise(none))
    d = d.withColumn("pool", E.pool(F.col("clean"), F.col("premises")))
    d = d.withColumn("scores", scorer(F.col("clean"), F.col("premises"))).withColumn("pool_scores", scorer(F.col("clean"), F.col("pool")))
    d = d.withColumn("best", E.best_scores(F.col("scores"))).withColumn("pooled", E.pooled_contradiction(F.col("pool_scores")))
    after = E.applied(F.col("status"), F.col("notes"), F.col("best.ent"), F.col("located"), F.col("best.con"), F.col("pooled"))
    d = d.withColumn("after", F.when(F.col("eligible"), after))
    moved = {c: F.when(F.col("eligible"), F.col(f"after.{c}")).otherwise(F.col(c)) for c in ("status", "tier_reached", "score")}
    quoted = F.when(F.col("span").isNotNull(), F.array(F.lit("the page states the claim verbatim"))).otherwise(none)
    return d.withColumn("notes", F.when(F.col("eligible"), F.concat("after.notes", quoted)).otherwise(F.col("notes"))).withColumns(moved)


def entity_guard(rows: DataFrame) -> DataFrame:
    """Support for a claim that names what its page never mentions is withdrawn, at any tier."""
    names = F.when(F.col("scored"), T.ungrounded_names(T.clean_claim(F.col("claim")), F.col("target"))).otherwise(F.array().cast("array<string>"))
    d = rows.withColumn("ungrounded", names).withColumn("vetoed", (F.col("status") == K.SUPPORTED) & (F.size("ungrounded") > 0))
    note = F.array(F.concat(F.lit("the claim names "), F.array_join(F.array_sort("ungrounded"), ", "), F.lit(" but the page never does: support vetoed")))
    return d.withColumn("notes", F.when(F.col("vetoed"), F.concat("notes", note)).otherwise(F.col("notes"))).withColumn("status", F.when(F.col("vetoed"), F.lit(K.UNSUPPORTED)).otherwise(F.col("status")))


def verify(citations: DataFrame, pages: DataFrame, *, use_overlap: bool = True, scorer: E.Scorer | None = None, versions: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts of citations (``sources.documents.CITATION``): one row for each, with the columns of ``VERDICT``.

    ``scorer`` turns the third tier on and with it the second. Null claims have no terms; null URLs find no page.
    """
    rows = first_tier(located(citations, pages, versions))
    if use_overlap or scorer is not None:
        rows = second_tier(rows)
        if scorer is not None:
            rows = third_tier(rows, scorer)
        rows = entity_guard(rows)
    return rows.select(*VERDICT)


def premise_pairs(citations: DataFrame, pages: DataFrame, versions: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, seq, claim, kind, i, premise``: what a scorer would read, as a table."""
    d = second_tier(first_tier(located(citations, pages, versions))).withColumn("clean", T.clean_claim(F.col("claim"))).where(F.col("scored") & (F.size("passages") > 0))
    top = F.transform(O.ranked(F.col("clean"), F.col("passages")), lambda p: p["passage"])
    span = T.verbatim_span(F.col("clean"), F.col("target"))
    x = d.select("doc_id", "seq", F.col("clean").alias("claim"), F.size("passages").alias("n"), F.posexplode(E.premises(F.col("clean"), top, F.col("target"), span)).alias("i", "premise"))
    return x.select("doc_id", "seq", "claim", F.when(F.col("i") >= F.least("n", F.lit(K.TOP_K)), F.lit("verbatim")).otherwise(F.lit("passage")).alias("kind"), "i", "premise")


