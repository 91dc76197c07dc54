"""The entailment tier: a pluggable scorer, premises, pooled contradiction and the bands."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import text as T

#: (claim, array of premises) -> array of struct<ent, con>, one for each premise.
Scorer = Callable[[Column, Column], Column]
SCORES = "array<struct<ent:double,con:double>>"


def lexical_scorer(claim: Column, premises: Column) -> Column:
    """The default: coverage of the claim's terms as entailment, a slot conflict as contradiction. Deterministic."""
    def scored(terms: Column) -> Column:
        one = lambda p, hit: F.struct(F.when(hit, F.lit(0.0)).otherwise(T.shared_fraction(terms, T.content_terms(p))).alias("ent"), F.when(hit, F.lit(0.9)).otherwise(F.lit(0.0)).alias("con"))
        return F.transform(premises, lambda p: T.let(T.slot_conflict(claim, p), lambda hit: one(p, hit)))

    return T.let(T.content_terms(T.clean_claim(claim)), scored)


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[tuple[float, float]]]], batch: int = 8) -> Scorer:
    """A scorer around a model: ``load()`` runs once in each Python worker and gives a function from (claim, premise)
    pairs to (entailment, contradiction). Pairs go in batches, the longest together."""

    def score(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for claims, premises in columns:
            pairs = [(c or "", p) for c, ps in zip(claims, premises, strict=True) for p in (ps if ps is not None else [])]
            order = sorted(range(len(pairs)), key=lambda i: -len(pairs[i][1]))
            got: list = [None] * len(pairs)
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                for j, s in zip(some, model([pairs[j] for j in some]), strict=True):
                    got[j] = {"ent": float(s[0]), "con": float(s[1])}
            found = iter(got)
            yield pd.Series([[next(found) for _ in (ps if ps is not None else [])] for ps in premises])

    # so marked, the call keeps a projection of its own: it runs once and is never folded into what reads its scores
    return F.pandas_udf(score, SCORES).asNondeterministic()


def model_available(*modules: str) -> bool:
    return all(importlib.util.find_spec(m) is not None for m in modules or ("torch", "transformers"))


def premises(claim: Column, top: Column, text: Column, span: Column) -> Column:
    """What the scorer reads: each top passage cut to its best sentence and set in its context; then the verbatim span."""
    chosen = F.transform(top, lambda p: T.expand_in_text(T.best_sentence(claim, T.clip_passage(claim, p)), text))
    return F.when(span.isNotNull(), F.concat(chosen, F.array(span))).otherwise(chosen)


def best_scores(scores: Column) -> Column:
    """The scores of the premise with most entailment, the first on ties."""
    ents = scores["ent"]  # no lambdas here: a Python scorer's result can't pass through them
    return F.get(scores, (F.array_position(ents, F.array_max(ents)) - 1).cast("int"))


def pool(claim: Column, chosen: Column) -> Column:
    """Sentences of the premises that are near the claim and disagree with it on a slot."""
    return F.filter(T.pool_sentences(claim, chosen), lambda s: T.slot_conflict(claim, s))


def pooled_contradiction(scores: Column) -> Column:
    """The largest contradiction, 0 without sentences."""
    return F.coalesce(F.greatest(F.array_max(scores["con"]), F.lit(0.0)), F.lit(0.0))


def combine_clauses(scores: Column) -> Column:
    """One score for all clauses: null for none, the floor of the ambiguous band if mixed, else the least."""
    vals = F.filter(scores, lambda s: s.isNotNull())
    low, high = F.array_min(vals), F.array_max(vals)
    return F.when(F.size(vals) <= 1, low).when((high >= K.ENTAIL_AMBIGUOUS) & (low < K.ENTAIL_AMBIGUOUS), F.greatest(low, F.lit(K.ENTAIL_AMBIGUOUS))).otherwise(low)


def band(score: Column) -> Column:
    return F.when(score >= K.ENTAIL_SUPPORTED, F.lit(K.SUPPORTED)).when(score >= K.ENTAIL_AMBIGUOUS, F.lit(K.AMBIGUOUS)).otherwise(F.lit(K.UNSUPPORTED))


def status(overlap_status: Column, score: Column, locatable: Column, contradiction: Column) -> Column:
    """Ambiguous where nothing could be located; else a strong contradiction, else the band of the score."""
    con = F.coalesce(contradiction, F.lit(0.0)) >= K.CONTRADICTION
    return F.when(~locatable, F.lit(K.AMBIGUOUS)).when(score.isNull(), overlap_status).when(con, F.lit(K.UNSUPPORTED)).otherwise(band(score))


def applied(overlap_status: Column, notes: Column, score: Column, locatable: Column, contradiction: Column, pooled: Column) -> Column:
    """``struct<status, tier_reached, score, notes>`` after this tier.

    Without a score the overlap verdict stands at tier 2. A pooled contradiction vetoes support and nothing else.
    """
    first = status(overlap_status, score, locatable, contradiction)
    veto = (F.coalesce(pooled, F.lit(0.0)) >= K.CONTRADICTION) & (first == K.SUPPORTED)
    final = F.when(veto, F.lit(K.UNSUPPORTED)).otherwise(first)
    said = F.concat(
        notes,
        F.array(F.format_string("entailment %.3f", score)),
        F.when(contradiction.isNotNull(), F.array(F.format_string("contradiction %.3f", contradiction))).otherwise(F.array().cast("array<string>")),
        F.when(contradiction >= K.CONTRADICTION, F.array(F.lit("the source contradicts the claim"))).otherwise(F.array().cast("array<string>")),
        F.when(veto, F.array(F.format_string("pooled contradiction %.3f", pooled))).otherwise(F.array().cast("array<string>")),
        F.when(final != overlap_status, F.array(F.concat(F.lit("entailment moved the verdict from "), overlap_status, F.lit(" to "), final))).otherwise(F.array().cast("array<string>")),
    )
    held = F.struct(overlap_status.alias("status"), F.lit(2).alias("tier_reached"), F.lit(None).cast("double").alias("score"), F.concat(notes, F.array(F.lit("nothing to score: verdict held at tier 2"))).alias("notes"))
    return F.when(score.isNull(), held).otherwise(F.struct(final.alias("status"), F.lit(3).alias("tier_reached"), F.bround(score, 4).alias("score"), said.alias("notes")))
