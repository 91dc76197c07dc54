"""Synthesis of labelled cases from page text, and validation of labels by n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import text as T
from attesta.sources.staging import frozen


def authorable(sentence: Column) -> Column:
    """Whether a sentence is of a shape that cases can be made of: length, plain characters, a number or a name."""
    n = F.size(F.filter(F.split(sentence, T.SPACES), lambda w: w != ""))
    plain = sentence.rlike(r"^[A-Za-z0-9 ,.\-'’%$£€/]+$")
    telling = sentence.rlike(r"\d") | F.substring(sentence, 2, 1_000_000).rlike(r"\b[A-Z][a-z]{3,}")
    capital = (sentence >= "A") & (sentence < "[")
    return capital & F.endswith(sentence, F.lit(".")) & plain & telling & n.between(*K.SENTENCE_WORDS)  # what costs least comes first


def negation(sentence: Column) -> Column:
    """``struct<claim, edit>``: "not" after the first auxiliary of the list that occurs; null without one.

    ``edit`` is the place of the new word among the claim's tokens.
    """
    made = None
    for aux in K.AUXILIARIES:
        at = F.instr(sentence, aux)
        head = F.concat(F.substring(sentence, F.lit(1), at - 1), F.lit(aux))
        tail = F.substring(sentence, at + len(aux), F.length(sentence))
        one = F.struct(F.concat(head, F.lit("not "), tail).alias("claim"), F.size(T.ngram_tokens(head)).alias("edit"))
        made = F.when(at > 0, one) if made is None else made.when(at > 0, one)
    return made


MID_NAME = r"(?<=[a-z] )[A-Z][a-z]{3,}"


def swap(sentence: Column, page: Column, taken: int = 0) -> Column:
    """``struct<claim, edit, name>``: the first name inside the sentence replaced by a pool name that the page lacks.

    ``taken`` names were used before on the page. Null where there is no name to replace or to use.
    """
    low = F.lower(page)
    free = F.filter(T.literal_array(K.SWAP_NAMES), lambda n: ~F.contains(low, F.lower(n)))
    at = F.regexp_instr(sentence, F.lit(MID_NAME))
    old = F.regexp_extract(sentence, f"({MID_NAME})", 1)
    name = F.get(free, F.lit(taken))
    head = F.substring(sentence, F.lit(1), at - 1)
    claim = F.concat(head, name, F.substring(sentence, at + F.length(old), F.length(sentence)))
    return F.when((at > 0) & name.isNotNull(), F.struct(claim.alias("claim"), F.size(T.ngram_tokens(head)).alias("edit"), name.alias("name")))


def candidates(pages: DataFrame, *, id_col: str, text_col: str, spread: int | None = None) -> DataFrame:
    """``page_id, i, sentence``: authorable sentences in order; with ``spread``, every k-th, k from their number."""
    s = pages.select(F.col(id_col).alias("page_id"), F.posexplode(T.sentences(F.col(text_col))).alias("at", "sentence")).where(authorable(F.col("sentence")))
    order = Window.partitionBy("page_id").orderBy("at")
    d = s.select("page_id", (F.row_number().over(order) - 1).alias("i"), "sentence", F.count("*").over(Window.partitionBy("page_id")).alias("n"))
    if spread:
        step = F.greatest(F.lit(1), F.floor(F.col("n") / spread))
        d = d.where(F.col("i") % step == 0)
    return d.select("page_id", "i", "sentence")


def first_made(items: Column, n: int, make: Callable[[Column], Column], kind: str) -> Column:
    """The first ``n`` values of SQL type ``kind`` that ``make`` gives for the items; nulls don't count. No item after the
    last one needed is looked at."""
    add = lambda some, v: F.when(v.isNotNull(), F.concat(some, F.array(v))).otherwise(some)
    return F.aggregate(items, F.array().cast(f"array<{kind}>"), lambda some, x: F.when(F.size(some) >= n, some).otherwise(T.let(make(x), lambda v: add(some, v))))


def _bare(sentence: Column) -> Column:
    return F.regexp_replace(T.strip(sentence), r"\.+$", "")


def false_clauses(sentences: Column, grams: Column) -> Column:
    """``array<struct<at, sentence, clause>>``: the negated first clause of each sentence that has one of five words whose
    negated wording isn't in the page (``grams`` are its runs of six tokens)."""
    def one(s: Column, at: Column) -> Column:
        def judged(neg: Column) -> Column:
            clause = _bare(F.get(F.split(neg["claim"], ","), F.lit(0)))
            absent = ~F.arrays_overlap(T.crossing_ngrams(neg["claim"], neg["edit"]), grams)
            return F.struct(at.alias("at"), s.alias("sentence"), F.when(neg.isNotNull(), T.let(clause, lambda c: F.when((F.size(F.split(c, T.SPACES)) >= 5) & absent, c))).alias("clause"))

        return T.let(negation(s), judged)

    return F.filter(F.transform(sentences, one), lambda x: x["clause"].isNotNull())


def mixed(a: Column, at: Column, clauses: Column, page: Column, grams: Column) -> Column:
    """Sentence ``a`` joined with the first false clause of another sentence, those after it first, that makes a claim the
    page lacks, or null. ``a`` itself must share a run of six tokens with the page."""
    def joined(x: Column) -> Column:
        clause = x["clause"]
        claim = F.concat(_bare(a), F.lit(", and "), F.lower(F.substring(clause, 1, 1)), F.substring(clause, F.lit(2), F.length(clause)), F.lit("."))
        return F.when(x["sentence"] != a, T.let(claim, lambda c: F.when(~F.contains(page, c), c)))

    order = F.concat(F.filter(clauses, lambda x: x["at"] > at), F.filter(clauses, lambda x: x["at"] < at))
    return F.when(F.arrays_overlap(T.ngrams(_bare(a)), grams), F.get(first_made(order, 1, joined, "string"), F.lit(0)))


def kept(rows: DataFrame, test: Column) -> DataFrame:
    """Rows that meet a test of costly columns. A plain filter goes below the columns and works them out there again, once for
    each use; one above a column that isn't deterministic stays in its place."""
    return rows.withColumn("_held", F.monotonically_increasing_id()).where(test & (F.col("_held") >= 0)).drop("_held")


def authored(pages: DataFrame, *, id_col: str, url_col: str, text_col: str, per_page: int = 7) -> DataFrame:
    """Cases of four families for each page, with quotas: two verbatim, two negated, two swapped, one mixed, ``per_page``
    in all; pages with fewer than three cases give none.

    ``id, page_id, category, expected_status, labeler_confidence, url, claim``. Everything of a page is in the row of
    that page, so a page is the unit of work and nothing is shuffled until ids are given out. Work is linear in sentences.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(text_col).alias("page"))
    p = kept(p.withColumn("every", F.filter(T.sentences(F.col("page")), authorable)), F.size("every") > 0)
    step = F.greatest(F.lit(1), F.floor(F.size("every") / F.lit(max(per_page * 4, 1)))).cast("int")
    p = p.withColumn("step", step).withColumn("picked", F.filter("every", lambda s, i: i % F.col("step") == 0)).withColumn("grams", T.ngrams(F.col("page")))
    absent = lambda x: ~F.arrays_overlap(T.crossing_ngrams(x["claim"], x["edit"]), F.col("grams"))
    verbatim = first_made("picked", 2, lambda s: F.when(F.arrays_overlap(T.ngrams(s), F.col("grams")), s), "string")
    negated = first_made("picked", 2, lambda s: T.let(negation(s), lambda x: F.when(x.isNotNull() & absent(x), x["claim"])), "string")
    p = p.withColumn("low", F.lower("page")).withColumn("free", F.filter(T.literal_array(K.SWAP_NAMES), lambda n: ~F.contains(F.col("low"), F.lower(n))))
    with_name = F.filter("picked", lambda s: F.regexp_instr(s, F.lit(MID_NAME)) > 0)

    def swapped(s: Column, i: Column) -> Column:
        at, old, name = F.regexp_instr(s, F.lit(MID_NAME)), F.regexp_extract(s, f"({MID_NAME})", 1), F.get("free", i)
        head = F.substring(s, F.lit(1), at - 1)
        return F.struct(F.concat(head, name, F.substring(s, at + F.length(old), F.length(s))).alias("claim"), F.size(T.ngram_tokens(head)).alias("edit"))

    swaps = first_made(F.transform(with_name, swapped), 2, lambda x: F.when(x["claim"].isNotNull() & absent(x), x["claim"]), "string")
    p = p.withColumn("clauses", false_clauses(F.col("picked"), F.col("grams")))
    tries = F.transform("picked", lambda s, i: F.struct(s.alias("s"), i.alias("at")))
    both = first_made(tries, 1, lambda x: mixed(x["s"], x["at"], F.col("clauses"), F.col("page"), F.col("grams")), "string")
    family = lambda claims, category, status: F.transform(claims, lambda c: F.struct(F.lit(category).alias("category"), F.lit(status).alias("expected_status"), c.alias("claim")))
    cases = F.concat(family(verbatim, "verbatim-supported", K.SUPPORTED), family(negated, "negation-flip", K.UNSUPPORTED), family(swaps, "entity-swap", K.UNSUPPORTED), family(both, "mixed-false-conjunct", K.UNSUPPORTED))
    p = kept(p.withColumn("cases", cases), F.size("cases") >= 3).select("page_id", "url", F.slice("cases", 1, per_page).alias("cases"))
    return p.select("page_id", "url", F.posexplode("cases").alias("k", "c")).select("page_id", "k", "c.category", "c.expected_status", F.lit("high").alias("labeler_confidence"), "url", "c.claim")


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their place in the given order, from 0. Numbers come from counts of range partitions, so no task sorts all rows."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # frozen, as range bounds come from a sample and would differ between the two uses
    ranged = frozen(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    out = inside.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_k") - 1).drop("_part", "_k", "_before")


def with_ids(cases: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Sequential ids in the given order, from 1. The cases are frozen, as range bounds take a sample of them before."""
    return numbered(frozen(cases), "_n", *order).withColumn("id", F.format_string(f"{prefix}%03d", F.col("_n") + 1)).drop("_n")


def label_problems(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """Contrast labels against page text: ``id, rule``.

    ``pages``: ``url, ok, text``. Supported claims share a shingle with their page, unsupported ones don't; a page with a
    supported case has two unsupported ones (the id of that row is the URL). Pages without text can't be compared.
    """
    d = cases.select("id", "url", "claim", "expected_status").join(pages.select("url", "ok", "text", T.shingles(F.col("text")).alias("grams")), "url", "left")
    shares = F.arrays_overlap(T.shingles(F.col("claim")), F.col("grams"))
    rule = (
        F.when(F.col("ok").isNull(), F.lit("url-not-in-pool"))
        .when(F.col("text").isNull() & F.col("ok"), F.lit("no-saved-text"))
        .when(F.col("text").isNotNull() & (F.col("expected_status") == K.SUPPORTED) & ~shares, F.lit("supported-but-absent"))
        .when(F.col("text").isNotNull() & (F.col("expected_status") == K.UNSUPPORTED) & shares, F.lit("unsupported-but-present"))
    )
    one = d.select("id", rule.alias("rule")).where("rule is not null")
    known = d.where("ok is not null").groupBy("url").agg(F.count_if(F.col("expected_status") == K.SUPPORTED).alias("p"), F.count_if(F.col("expected_status") == K.UNSUPPORTED).alias("n"))
    return one.unionByName(known.where("p > 0 and n < 2").select(F.col("url").alias("id"), F.lit("too-few-negatives").alias("rule")))


def case_problems(cases: DataFrame, pages: DataFrame, older: DataFrame | None = None, prefix: str = "ind3-") -> DataFrame:
    """All rules for a set of cases: ``id, severity, rule``.

    Required fields, domains of status and confidence, id prefix, URL scheme, claim; clauses of mixed cases; clause
    shingles in the page (absence of a supported one is a problem, presence of an unsupported one a warning); repeated
    ids, ids of ``older`` sets (problems) and their URLs (warnings).
    """
    d = cases.join(pages.select("url", "ok", "text", T.shingles(F.col("text")).alias("page_grams")), "url", "left")
    c = F.col
    missing = c("id").isNull() | c("category").isNull() | c("expected_status").isNull() | c("labeler_confidence").isNull() | c("url").isNull() | c("claim").isNull() | c("notes").isNull() | c("supported_clauses").isNull() | c("unsupported_clauses").isNull()
    in_page = lambda s: F.arrays_overlap(T.shingles(s), c("page_grams"))
    has_text, excused = c("text").isNotNull(), c("expected_status").isin(K.UNREACHABLE, K.PAYWALLED)
    rules = [
        ("problem", "missing-keys", missing),
        ("problem", "id-prefix", ~missing & ~F.startswith(c("id"), F.lit(prefix))),
        ("problem", "status", ~missing & ~c("expected_status").isin(*K.VERDICTS)),
        ("problem", "confidence", ~missing & ~c("labeler_confidence").isin(*K.CONFIDENCES)),
        ("problem", "url-scheme", ~missing & ~c("url").rlike("^https?://")),
        ("problem", "empty-claim", ~missing & (T.strip(c("claim")) == "")),
        ("problem", "mixed-without-supported-clauses", ~missing & (c("category") == "partially-true-mixed") & (F.size("supported_clauses") == 0)),
        ("problem", "mixed-without-unsupported-clauses", ~missing & (c("category") == "partially-true-mixed") & (F.size("unsupported_clauses") == 0)),
        ("problem", "url-not-in-pool", ~missing & c("ok").isNull() & ~excused),
        ("problem", "no-saved-text", ~missing & c("ok") & ~has_text),
        ("problem", "supported-clause-absent", ~missing & has_text & F.exists("supported_clauses", lambda s: ~in_page(s))),
        ("warning", "unsupported-clause-present", ~missing & has_text & F.exists("unsupported_clauses", in_page)),
        ("problem", "supported-but-absent", ~missing & has_text & (c("expected_status") == K.SUPPORTED) & (F.size("supported_clauses") == 0) & ~in_page(c("claim"))),
    ]
    found = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, test in rules])
    out = d.select(F.coalesce("id", F.lit("<no-id>")).alias("id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("id", "x.severity", "x.rule")
    out = out.unionByName(cases.groupBy("id").count().where("count > 1").select("id", F.lit("problem").alias("severity"), F.lit("duplicate-id").alias("rule")))
    if older is not None:
        out = out.unionByName(cases.select("id").intersect(older.select("id")).select("id", F.lit("problem").alias("severity"), F.lit("id-collision").alias("rule")))
        out = out.unionByName(cases.select("url").intersect(older.select("url")).select(F.col("url").alias("id"), F.lit("warning").alias("severity"), F.lit("url-reused").alias("rule")))
    return out


def perf_subset(cases: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` cases that reach the later tiers."""
    return cases.where(F.col("expected_status").isin(K.SUPPORTED, K.UNSUPPORTED, K.AMBIGUOUS)).orderBy(*order).limit(n)
