"""Overlap scoring: weighted coverage of a claim's terms, inside a row or between whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import text as T
from attesta.sources.staging import frozen


def coverage(weights: Column, terms: Column) -> Column:
    """Share of the weight (``array<struct<term, weight>>``) whose terms are present; 0 without weight or terms."""
    start = F.struct(F.lit(0.0).alias("hit"), F.lit(0.0).alias("total"))
    add = lambda s, w: F.struct((s["hit"] + F.when(F.array_contains(terms, w["term"]), w["weight"]).otherwise(F.lit(0.0))).alias("hit"), (s["total"] + w["weight"]).alias("total"))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.aggregate(weights, start, add, lambda s: F.when(s["total"] > 0, s["hit"] / s["total"]).otherwise(F.lit(0.0))))


def status_for_score(score: Column) -> Column:
    return F.when(score >= K.HIGH_OVERLAP, F.lit(K.SUPPORTED)).when(score >= K.LOW_OVERLAP, F.lit(K.AMBIGUOUS)).otherwise(F.lit(K.UNSUPPORTED))


def passage_terms(passages: Column) -> Column:
    """Each passage beside its content terms, so that they are made once for all clauses of all claims."""
    return F.transform(passages, lambda p: F.struct(p.alias("passage"), T.content_terms(p).alias("terms")))


def ranked(claim: Column, passages: Column, top_k: int = K.TOP_K) -> Column:
    """The ``top_k`` passages (of ``passage_terms``) by rounded coverage, first ones first on ties."""
    def chosen(weights: Column) -> Column:
        scored = F.transform(passages, lambda p, i: F.struct((-F.bround(coverage(weights, p["terms"]), 4)).alias("minus"), i.alias("i"), p["passage"].alias("passage")))
        return F.transform(F.slice(F.array_sort(scored), 1, max(0, top_k)), lambda x: F.struct((-x["minus"]).alias("score"), x["passage"].alias("passage")))

    return T.let(T.term_weights(T.clean_claim(claim)), chosen)


def best(claim: Column, passages: Column) -> Column:
    """``struct<score, evidence>`` of the best passage; (0, "") without terms or passages."""
    return T.let(T.term_weights(T.clean_claim(claim)), lambda weights: _best(weights, passages))


def _best(weights: Column, passages: Column) -> Column:
    none = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("evidence"))

    scored = F.transform(passages, lambda p, i: F.struct(F.bround(coverage(weights, p["terms"]), 4).alias("score"), (-i).alias("back"), p["passage"].alias("passage")))
    found = lambda top: F.when((F.size(weights) > 0) & top.isNotNull(), F.struct(top["score"].alias("score"), T.clipped(top["passage"]).alias("evidence"))).otherwise(none)
    return T.let(F.array_max(scored), found)


def compound(claim: Column, passages: Column) -> Column:
    """``best``, but a claim of several clauses of which some are covered and some are not scores at the low threshold
    and shows the evidence of its first worst clause.

    Of a passage's terms only those that the claim has count, so they are picked out once for all clauses.
    """
    weigh = lambda c: T.term_weights(T.clean_claim(c))

    def judged(each: Column, whole: Column, near: Column) -> Column:
        scores = F.transform(each, lambda x: x["score"])
        worst = F.get(F.filter(each, lambda x: x["score"] == F.array_min(scores)), F.lit(0))
        mixed = (F.size(each) > 1) & (F.array_max(scores) >= K.LOW_OVERLAP) & (F.array_min(scores) < K.LOW_OVERLAP)
        return F.when(mixed, F.struct(F.greatest(F.array_min(scores), F.lit(K.LOW_OVERLAP)).alias("score"), worst["evidence"].alias("evidence"))).otherwise(_best(whole, near))

    def met(w: Column) -> Column:
        wanted = F.flatten(F.transform(F.concat(F.array(w["whole"]), w["clauses"]), lambda x: F.transform(x, lambda t: t["term"])))
        kept = lambda terms: F.transform(passages, lambda p: F.struct(p["passage"].alias("passage"), F.array_intersect(terms, p["terms"]).alias("terms")))
        return T.let(T.let(wanted, kept), lambda near: T.let(F.transform(w["clauses"], lambda x: _best(x, near)), lambda each: judged(each, w["whole"], near)))

    return T.let(F.struct(weigh(claim).alias("whole"), F.transform(T.compound_clauses(claim), weigh).alias("clauses")), met)


def exploded_weights(claims: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``claim_id, term, weight, total`` of each claim's terms."""
    w = claims.select(F.col(id_col).alias("claim_id"), T.term_weights(T.clean_claim(F.col(text_col))).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["weight"])
    return w.select("claim_id", F.inline("w"), total.alias("total")).select("claim_id", "term", "weight", "total")


def scored_pairs(claims: DataFrame, sources: DataFrame, *, claim_id: str, claim_text: str, source_id: str, source_text: str) -> DataFrame:
    """``claim_id, source_id, score`` of every claim and source that share a term, over whole tables.

    A join on the term and a sum for each pair, which Spark combines before the shuffle; source terms that no claim has
    go before the join. Repeated ids are judged together, nulls never meet.
    """
    terms = exploded_weights(claims, claim_id, claim_text)
    have = sources.select(F.col(source_id).alias("source_id"), F.explode(T.content_terms(F.col(source_text))).alias("term"))
    met = have.join(terms, "term")
    return met.groupBy("claim_id", "source_id", "total").agg(F.sum("weight").alias("hit")).select("claim_id", "source_id", F.bround(F.col("hit") / F.col("total"), 4).alias("score"))


def leading_pairs(claims: DataFrame, sources: DataFrame, *, claim_id: str, claim_text: str, source_id: str, source_text: str) -> DataFrame:
    """Those of ``scored_pairs`` that can be the best of their claim, with exact scores.

    A claim's rarest terms, of more than half its weight, lead: sources are joined by them first. Where the best score so far is
    above what all other terms together could give, no source without a leading term can win, and of those with one only
    sources that could still reach the best are looked up for the other terms. So a frequent term, which most sources
    have, is never joined by itself. Claims of which that can't be said are joined by all their terms.
    """
    terms = frozen(exploded_weights(claims, claim_id, claim_text))
    have = sources.select(F.col(source_id).alias("source_id"), F.explode(T.content_terms(F.col(source_text))).alias("term")).where("source_id is not null")
    have = frozen(have.join(terms.select("term").distinct(), "term", "left_semi"))
    often = terms.join(have.groupBy("term").count(), "term", "left").na.fill(0, ["count"])
    before = F.coalesce(F.sum("weight").over(Window.partitionBy("claim_id").orderBy("count", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a claim's terms
    dealt = frozen(often.withColumn("leads", before <= F.col("total") / 2).drop("count"))
    rest = dealt.groupBy("claim_id").agg(F.sum(F.when(~F.col("leads"), F.col("weight")).otherwise(F.lit(0.0))).alias("rest"))
    some = have.join(dealt.where("leads"), "term").groupBy("claim_id", "source_id", "total").agg(F.sum("weight").alias("hit"))
    some = frozen(some.join(rest, "claim_id"))
    score = lambda hit: F.bround(hit / F.col("total"), 4)
    sure = some.groupBy("claim_id").agg(F.max(score(F.col("hit"))).alias("best"), F.max(score(F.col("rest"))).alias("most")).where("best > most")
    near = some.join(sure, "claim_id").where(score(F.col("hit") + F.col("rest")) >= F.col("best")).select("claim_id", "source_id", "total", "hit")
    more = near.join(dealt.where("not leads").select("claim_id", "term", "weight"), "claim_id").join(have, ["source_id", "term"]).select("claim_id", "source_id", "total", F.col("weight").alias("hit"))
    whole = near.unionByName(more)
    open_ = have.join(terms.join(sure, "claim_id", "left_anti"), "term").select("claim_id", "source_id", "total", F.col("weight").alias("hit"))
    return whole.unionByName(open_).groupBy("claim_id", "source_id", "total").agg(F.sum("hit").alias("hit")).select("claim_id", "source_id", score(F.col("hit")).alias("score"))


def best_sources(pairs: DataFrame) -> DataFrame:
    """The best source of each claim (the least id on ties), by a partial aggregate rather than a sort."""
    top = pairs.groupBy("claim_id").agg(F.max(F.struct("score", (-F.col("source_id")).alias("back"))).alias("m"))
    return top.select("claim_id", (-F.col("m.back")).alias("source_id"), F.col("m.score").alias("score"), status_for_score(F.col("m.score")).alias("status"))


def exact_pairs(claims: DataFrame, sources: DataFrame, *, claim_id: str, claim_text: str, source_id: str, source_text: str, n: int = 6) -> DataFrame:
    """``claim_id, source_id, span`` where a source holds a claim of ten tokens or more token for token.

    Candidates share the claim's first run of ``n`` tokens, an equi-join with one row for each claim; the whole claim is
    then looked up in the candidate's text.
    """
    c = claims.select(F.col(claim_id).alias("claim_id"), F.col(claim_text).alias("claim"), T.verbatim_tokens(F.col(claim_text)).alias("tokens")).where(F.size("tokens") >= K.VERBATIM_MIN_TOKENS)
    keys = c.select("claim_id", "claim", F.array_join(F.slice("tokens", 1, n), " ").alias("gram"))
    grams = sources.select(F.col(source_id).alias("source_id"), F.explode(F.array_distinct(T.windows(T.verbatim_tokens(F.col(source_text)), n))).alias("gram"))
    met = grams.join(keys, "gram").select("source_id", "claim_id", "claim").distinct()
    texts = sources.select(F.col(source_id).alias("source_id"), F.col(source_text).alias("text"))
    return met.join(texts, "source_id").select("claim_id", "source_id", T.verbatim_span(F.col("claim"), F.col("text")).alias("span")).where("span is not null")


def positional_runs(claims: DataFrame, sources: DataFrame, *, claim_id: str, claim_text: str, source_id: str, source_text: str, n: int = 6) -> DataFrame:
    """``claim_id, source_id, longest``: the longest common run of tokens, where it has ``n`` or more.

    Windows of ``n`` tokens are joined; those on one diagonal (difference of positions) and consecutive form a run.
    """
    grams = lambda d, i, t, p: d.select(F.col(i).alias(f"{p}_id"), F.posexplode(T.windows(T.verbatim_tokens(F.col(t)), n)).alias(f"{p}_pos", "gram"))
    met = grams(claims, claim_id, claim_text, "claim").join(grams(sources, source_id, source_text, "source"), "gram")
    line = ["claim_id", "source_id", "diagonal"]
    at = met.withColumn("diagonal", F.col("source_pos") - F.col("claim_pos"))
    islands = at.withColumn("island", F.col("claim_pos") - F.row_number().over(Window.partitionBy(*line).orderBy("claim_pos")))
    runs = islands.groupBy(*line, "island").agg((F.count("*") + n - 1).alias("run"))
    return runs.groupBy("claim_id", "source_id").agg(F.max("run").alias("longest"))


def shingle_matches(claims: DataFrame, sources: DataFrame, *, claim_id: str, claim_text: str, source_id: str, source_text: str, n: int = 6) -> DataFrame:
    """``claim_id, source_id, shared``: numbers of common white-space shingles, where there are any."""
    a = claims.select(F.col(claim_id).alias("claim_id"), F.explode(T.shingles(F.col(claim_text), n)).alias("gram"))
    b = sources.select(F.col(source_id).alias("source_id"), F.explode(T.shingles(F.col(source_text), n)).alias("gram"))
    return b.join(a, "gram").groupBy("claim_id", "source_id").agg(F.count("*").alias("shared"))


def contaminated(sources: DataFrame, claims: DataFrame, *, source_id: str, source_text: str, claim_text: str, n: int = 6) -> DataFrame:
    """Distinct ids of sources that share a shingle with any claim."""
    grams = claims.select(F.explode(T.shingles(F.col(claim_text), n)).alias("gram")).distinct()
    have = sources.select(F.col(source_id).alias("source_id"), F.explode(T.shingles(F.col(source_text), n)).alias("gram"))
    return have.join(grams, "gram", "left_semi").select("source_id").distinct()
