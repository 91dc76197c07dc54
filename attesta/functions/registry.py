"""SQL names for the text functions: SQL functions where Catalyst can inline them, one table function for passages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import pages, text, urls

#: SQL name -> (arguments, return type, column function)
FUNCTIONS = {
    "clean_claim": ("claim string", "string", text.clean_claim),
    "content_terms": ("body string", "array<string>", text.content_terms),
    "entity_terms": ("body string", "array<string>", text.entity_terms),
    "term_weights": ("body string", "array<struct<term:string,weight:double>>", text.term_weights),
    "split_sentences": ("body string", "array<string>", text.sentences),
    "segment_passages": ("body string", "array<string>", text.segment_passages),
    "compound_clauses": ("claim string", "array<string>", text.compound_clauses),
    "proper_nouns": ("body string", "array<string>", text.proper_nouns),
    "ngrams6": ("body string", "array<string>", text.ngrams),
    "shingles6": ("body string", "array<string>", text.shingles),
    "has_negation": ("body string", "boolean", text.has_negation),
    "best_sentence": ("claim string, passage string", "string", text.best_sentence),
    "clip_passage": ("claim string, passage string", "string", text.clip_passage),
    "slot_conflict": ("claim string, sentence string", "boolean", text.slot_conflict),
    "verbatim_span": ("claim string, body string", "string", text.verbatim_span),
    "ungrounded_names": ("claim string, body string", "array<string>", text.ungrounded_names),
    "html_text": ("html string", "string", pages.html_text),
    "has_paywall": ("html string", "boolean", pages.has_paywall),
    "has_retraction": ("html string", "boolean", pages.has_retraction),
    "normalized_url": ("url string", "string", urls.normalized),
    "cache_key": ("url string, etag string", "string", urls.cache_key),
}


class Passages:
    """``SELECT * FROM segment(text)``: (idx, passage), for passages of one very long text, sentence by sentence."""

    def eval(self, body: str) -> Iterator[tuple[int, str]]:
        for i, p in enumerate(passages_of(body)):
            yield i, p


def passages_of(body: str | None) -> Iterator[str]:
    """What ``text.segment_passages`` gives, as a generator in memory for one passage."""
    import re

    line = " ".join((body or "").split())
    held, buf, before = None, "", ""
    for sent in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+", line))):
        whole = lambda s: bool(buf) and len(buf) + 1 + len(s) > K.PASSAGE_MAX_CHARS  # noqa: B023, E731
        full = sent
        if sent.split()[0].lower() in K.ANAPHORS and before and (whole(sent) or not buf.endswith(before)):
            full = f"{before} {sent}"
        if whole(full):
            if held is not None:
                yield held
            held, buf = buf, full
        else:
            buf = f"{buf} {full}".strip()
        before = sent
    if held is not None and buf and len(buf) < K.PASSAGE_MIN_CHARS:
        yield f"{held} {buf}"
    else:
        yield from (p for p in (held, buf) if p)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session's SQL; returns their names.

    Each is written out as a SQL expression over its parameters, so the optimiser sees through it. A function whose
    expression has no SQL text (lambdas with nested structs) is left to the DataFrame API.
    """
    done = []
    for name, (args, kind, make) in FUNCTIONS.items():
        names = [a.split()[0] for a in args.split(", ")]
        try:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {sql_text(spark, make(*map(F.col, names)), args)}")
            done.append(name)
        except Exception as e:  # noqa: BLE001  the parser's own errors are of several kinds
            if type(e).__name__ not in ("ParseException", "AnalysisException"):
                raise
    segment = F.udtf(Passages, returnType="idx int, passage string")
    spark.udtf.register("segment", segment)
    return [*done, "segment"]


def sql_text(spark: SparkSession, column: Column, args: str) -> str:
    """The SQL of an expression over named parameters, as the analyser resolves it."""
    rows = spark.createDataFrame([], args)
    plan = rows.select(column.alias("x"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql().replace("`", "")
