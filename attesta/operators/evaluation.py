"""Evaluation of runs: agreement, confusion, recall, intervals, paired tests, baselines, sweeps and splits.

``records`` have ``id, category, expected, predicted`` and, where used, ``tier_reached``; ``cases`` have the columns of
``sources.cases.CASE``. Every measure is one grouped aggregate, so Spark combines it before its shuffle.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.stats import cluster_bootstrap, folded_bootstrap, mcnemar, ratio, wilson
from attesta.functions.text import normal_status
from attesta.functions.urls import authority
from attesta.operators.authoring import numbered

NAN = float("nan")


def graded(records: DataFrame) -> DataFrame:
    """Records with normal statuses and ``match``."""
    d = records.withColumn("expected", normal_status(F.col("expected"))).withColumn("predicted", normal_status(F.col("predicted")))
    return d.withColumn("match", F.col("expected") == F.col("predicted"))


def _dimension(like: DataFrame, name: str, values) -> DataFrame:
    return like.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"{name}_order int, {name} string")


def confusion_matrix(records: DataFrame) -> DataFrame:
    """A row for each expected status, a column for each predicted one, zeros kept."""
    d = graded(records)
    counts = d.groupBy("expected").agg(*[F.count_if(F.col("predicted") == s).alias(s) for s in K.STATUSES])
    full = _dimension(records, "expected", K.STATUSES).join(counts, "expected", "left")
    return full.select("expected", *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in K.STATUSES])


def category_recall(records: DataFrame) -> DataFrame:
    """Share of each category's cases that got the category's status; NaN for a category without cases."""
    names = _dimension(records, "category", sorted(K.CANONICAL)).withColumn("canonical_status", F.element_at(F.create_map(*[F.lit(x) for kv in K.CANONICAL.items() for x in kv]), F.col("category")))
    counts = graded(records).groupBy("category", "predicted").agg(F.count("*").alias("n"))
    d = names.join(counts, "category", "left").groupBy("category", "canonical_status")
    sums = d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("predicted") == F.col("canonical_status"), F.col("n"))), F.lit(0)).alias("correct"))
    return sums.withColumn("recall", ratio(F.col("correct"), F.col("total"), NAN))


def status_precision_recall(records: DataFrame) -> DataFrame:
    """``tp, fp, fn, precision, recall`` of each status; NaN where a denominator is 0."""
    d = graded(records).groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    hit = F.col("expected") == F.col("predicted")
    zero = F.lit(0).cast("long")
    sides = d.select(F.col("expected").alias("status"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp"), F.when(~hit, F.col("n")).otherwise(zero).alias("fn")).unionByName(
        d.where(~hit).select(F.col("predicted").alias("status"), zero.alias("tp"), F.col("n").alias("fp"), zero.alias("fn"))
    )
    sums = _dimension(records, "status", K.STATUSES).join(sides, "status", "left").groupBy("status").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), NAN)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), NAN))


def safety_rate(records: DataFrame, *categories: str) -> DataFrame:
    """Cases that should be unsupported but were supported, of each category's cases."""
    d = graded(records).where(F.col("category").isin(*categories))
    bad = F.count_if((F.col("predicted") == K.SUPPORTED) & (F.col("expected") == K.UNSUPPORTED))
    return d.groupBy("category").agg(bad.alias("false_supported"), F.count("*").alias("total")).withColumn("rate", ratio(F.col("false_supported"), F.col("total"), NAN))


def agreement(records: DataFrame, **keys: Column) -> DataFrame:
    """``correct, total, agreement`` and the Wilson bounds, over all records or by named key expressions."""
    d = graded(records).groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count_if("match").alias("correct"), F.count("*").alias("total"))
    low, high = wilson(F.col("correct"), F.col("total"))
    return d.withColumn("agreement", ratio(F.col("correct"), F.col("total"))).withColumn("low", low).withColumn("high", high)


def confidence_breakdown(records: DataFrame, cases: DataFrame) -> DataFrame:
    """Agreement by the labeller's confidence; records of unknown cases don't count."""
    d = graded(records).join(cases.select("id", "labeler_confidence").dropDuplicates(["id"]), "id")
    return d.groupBy("labeler_confidence").agg(F.count_if("match").alias("correct"), F.count("*").alias("total")).withColumn("agreement", ratio(F.col("correct"), F.col("total")))


def ablation(records: DataFrame, cases: DataFrame) -> DataFrame:
    """Accuracy of each ``config``, overall, by tier and by confidence, in one pass with grouping sets.

    Records of unknown cases have confidence ``unknown``; ``tier`` and ``confidence`` are null where a row is over all.
    """
    known = cases.select("id", "labeler_confidence").dropDuplicates(["id"])
    d = graded(records).join(known, "id", "left").select("config", F.coalesce("tier_reached", F.lit(0)).alias("tier"), F.coalesce("labeler_confidence", F.lit("unknown")).alias("confidence"), "match")
    sets = d.groupingSets([[F.col("config")], [F.col("config"), F.col("tier")], [F.col("config"), F.col("confidence")]], "config", "tier", "confidence").agg(F.count_if("match").alias("matched"), F.count("*").alias("total"))
    low, high = wilson(F.col("matched"), F.col("total"))
    return sets.withColumn("accuracy_pct", F.bround(100 * ratio(F.col("matched"), F.col("total")), 2)).withColumn("low_pct", F.bround(100 * low, 2)).withColumn("high_pct", F.bround(100 * high, 2))


def paired(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``id, category, before, after`` of records in both runs (null where one lacks the id)."""
    a = graded(baseline).select("id", F.col("category").alias("c0"), F.col("match").alias("before"))
    b = graded(current).select("id", F.col("category").alias("c1"), F.col("match").alias("after"))
    return a.join(b, "id", "full_outer").select("id", F.coalesce("c1", "c0").alias("category"), "before", "after")


def mcnemar_test(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: cases only the current run has right (b), only the baseline has (c), the statistic and the p-value."""
    d = paired(current, baseline).where("before is not null and after is not null")
    counts = d.agg(F.count_if(F.col("after") & ~F.col("before")).alias("b"), F.count_if(F.col("before") & ~F.col("after")).alias("c"))
    statistic, p = mcnemar(F.col("b"), F.col("c"))
    return counts.withColumn("statistic", statistic).withColumn("p_value", p)


def run_difference(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``id, category, change``: cases gained and lost. A case that a run lacks counts as not matched there."""
    before, after = F.coalesce("before", F.lit(False)), F.coalesce("after", F.lit(False))
    return paired(current, baseline).where(before != after).select("id", "category", F.when(after, F.lit("gained")).otherwise(F.lit("lost")).alias("change"))


def family_deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Correct cases of each category in both runs, and the difference."""
    one = lambda d, n: graded(d).groupBy("category").agg(F.count_if("match").alias(f"{n}_correct"), F.count("*").alias(f"{n}_total"))
    a, b = one(baseline, "base"), one(current, "rule").withColumnRenamed("category", "other")
    both = a.join(b, F.col("category").eqNullSafe(F.col("other")), "full_outer").withColumn("category", F.coalesce("category", "other")).drop("other").na.fill(0)
    return both.withColumn("delta", F.col("rule_correct") - F.col("base_correct"))


def acceptance_gate(current: DataFrame, baseline: DataFrame, *, family: str, least_gain: int = 5, most_loss: int = 2) -> DataFrame:
    """One row: the family's gain, the overall change, the worst loss among shared families, and whether all pass."""
    d = family_deltas(current, baseline)
    shared = (F.col("base_total") > 0) & (F.col("rule_total") > 0)
    row = d.agg(F.coalesce(F.sum(F.when(F.col("category") == family, F.col("delta"))), F.lit(0)).alias("gain"), F.coalesce(F.sum("delta"), F.lit(0)).alias("overall"), F.greatest(F.lit(0), F.coalesce(F.max(F.when(shared, -F.col("delta"))), F.lit(0))).alias("worst_loss"))
    return row.withColumn("passed", (F.col("gain") >= least_gain) & (F.col("overall") >= -most_loss) & (F.col("worst_loss") <= most_loss))


def contrast(records: DataFrame, cases: DataFrame) -> DataFrame:
    """A verdict for each page with a supported case and two unsupported ones.

    ``miss`` if the first supported case (by id) wasn't supported; else by which negatives were: negation flips are a
    polarity bug, others a binding bug. Pages whose first supported case has no record are left out.
    """
    r = records.select(F.col("id"), normal_status(F.col("predicted")).alias("predicted"))
    d = cases.select("id", "url", "category", "expected_status").join(r, "id", "left")
    positive, negative = F.col("expected_status") == K.SUPPORTED, F.col("expected_status") == K.UNSUPPORTED
    wrong = negative & (F.coalesce("predicted", F.lit("")) == K.SUPPORTED)
    flip = F.col("category") == "negation-flip"
    pages = d.groupBy("url").agg(
        F.min_by(F.struct("id", "predicted"), F.when(positive, F.col("id"))).alias("first"), F.count_if(positive).alias("positives"), F.count_if(negative).alias("negatives"),
        F.bool_or(wrong & flip).alias("polarity"), F.bool_or(wrong & ~flip).alias("binding"),
    ).where((F.col("positives") > 0) & (F.col("negatives") >= 2) & F.col("first.predicted").isNotNull())
    verdict = (
        F.when(F.col("first.predicted") != K.SUPPORTED, F.lit("miss"))
        .when(F.col("polarity") & F.col("binding"), F.lit("polarity-bug+binding-bug"))
        .when(F.col("polarity"), F.lit("polarity-bug"))
        .when(F.col("binding"), F.lit("binding-bug"))
        .otherwise(F.lit("clean"))
    )
    return pages.select("url", F.col("first.id").alias("positive_id"), verdict.alias("verdict"))


def model_scores(records: DataFrame) -> DataFrame:
    """By ``model`` and category: recall, and how often unsupported cases were supported."""
    d = graded(records)
    bad = F.col("expected") == K.UNSUPPORTED
    sums = d.groupBy("model", "category").agg(F.count_if("match").alias("correct"), F.count("*").alias("total"), F.count_if(bad & (F.col("predicted") == K.SUPPORTED)).alias("false_supported"), F.count_if(bad).alias("unsupported"))
    return sums.withColumn("recall", F.bround(ratio(F.col("correct"), F.col("total"), None), 4)).withColumn("false_rate", F.bround(ratio(F.col("false_supported"), F.col("unsupported"), None), 4))


def flips(arms: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows whose two arms (columns of predicted statuses) differ."""
    return arms.where(~F.col(a).eqNullSafe(F.col(b)))


def arm_summary(arms: DataFrame, *names: str) -> DataFrame:
    """Agreement and false support of each arm: the arms' columns are turned into rows and counted once."""
    long = arms.unpivot(["id", "expected"], list(names), "arm", "predicted")
    bad = F.col("expected") == K.UNSUPPORTED
    return long.groupBy("arm").agg(F.count_if(F.col("expected") == F.col("predicted")).alias("correct"), F.count("*").alias("total"), F.count_if(bad & (F.col("predicted") == K.SUPPORTED)).alias("false_supported"))


def set_summary(cases: DataFrame) -> DataFrame:
    """Cases and distinct hosts of each category."""
    return cases.groupBy("category").agg(F.count("*").alias("n_cases"), F.count_distinct(authority(F.col("url"))).alias("n_hosts"))


def sweep(scored: DataFrame, overlaps: list[float], margins: list[float], sentences: DataFrame) -> DataFrame:
    """Agreement and false support for each cell of a grid.

    ``scored``: ``id, category, expected, best_entail``; ``sentences``: ``id, overlap, con``. Only the largest
    contradiction at each overlap step matters, so sentences are reduced to a row for each case and step before the grid
    (literals) is crossed in.
    """
    spark = scored.sparkSession
    cuts = spark.createDataFrame([(float(o),) for o in overlaps], "min_overlap double")
    grid = spark.createDataFrame([(float(m),) for m in margins], "margin double")
    at = F.explode(F.filter(F.array(*[F.lit(float(o)) for o in overlaps]), lambda o: F.col("overlap") >= o)).alias("min_overlap")
    pools = sentences.select("id", "con", at).groupBy("id", "min_overlap").agg(F.max("con").alias("con"))
    cells = scored.crossJoin(F.broadcast(cuts)).join(pools, ["id", "min_overlap"], "left").crossJoin(F.broadcast(grid))  # the grid is literal
    con, ent = F.coalesce("con", F.lit(0.0)), F.col("best_entail")
    unsupported = (ent < K.ENTAIL_SUPPORTED) | ((con >= K.CONTRADICTION) & (con > ent + F.col("margin")))
    d = cells.withColumn("predicted", F.when(unsupported, F.lit(K.UNSUPPORTED)).otherwise(F.lit(K.SUPPORTED)))
    wrong = (F.col("expected") == K.UNSUPPORTED) & (F.col("predicted") == K.SUPPORTED)
    return d.groupBy("min_overlap", "margin").agg(F.count_if(F.col("predicted") == F.col("expected")).alias("agreement"), F.count_if(wrong & (F.col("category") == "negation-flip")).alias("negation_false"), F.count_if(wrong & (F.col("category") == "entity-swap")).alias("swap_false"))


def best_cells(cells: DataFrame, n: int = 10) -> DataFrame:
    return cells.orderBy(F.desc("agreement"), "swap_false", F.desc("negation_false"), "min_overlap", "margin").limit(n)


def bootstrap_interval(records: DataFrame, cases: DataFrame, confidence: float = 0.95, resamples: int = 10_000, seed: int = 0, walk: bool = False) -> DataFrame:
    """One row: ``n_clusters, low, high`` of accuracy when whole pages are resampled.

    Counts of each cluster are made by Spark, and clusters with equal (correct, size) are folded; only those kinds with
    their frequency reach the driver. A resample is one multinomial draw over the kinds, so neither time nor memory grows
    with the clusters. ``walk`` draws cluster by cluster instead, in the order and with the generator of
    ``stats.cluster_bootstrap``, for small sets whose published bounds are to be met digit by digit.
    """
    urls = cases.select("id", "url").dropDuplicates(["id"])
    d = graded(records).join(urls, "id", "left").groupBy(F.coalesce("url", "id").alias("cluster")).agg(F.count_if("match").alias("correct"), F.count("*").alias("size"))
    kinds = d.groupBy("correct", "size").agg(F.count("*").alias("n")).orderBy("correct", "size").collect()  # a row for each kind
    if walk:
        hits, sizes = ([r[c] for r in kinds for _ in range(r["n"])] for c in ("correct", "size"))
        low, high = cluster_bootstrap(hits, sizes, confidence, resamples, seed)
    else:
        low, high = folded_bootstrap([(r["correct"], r["size"], r["n"]) for r in kinds], confidence, resamples, seed)
    return records.sparkSession.createDataFrame([(sum(r["n"] for r in kinds), low, high)], "n_clusters long, low double, high double")


def _imbalance(side: Counter, other: Counter, statuses: list[str]) -> float:
    n, m = side.total(), other.total()
    if not n + m:
        return 0.0
    share = lambda c, k, s: c[s] / k if k else 0.0
    return abs(n - m) / (n + m) + sum(abs(share(side, n, s) - share(other, m, s)) for s in statuses)


def split_by_url(cases: DataFrame, seed: int = 42, most_urls: int = 1_000_000) -> DataFrame:
    """``id, url, side``: whole pages dealt to ``tune`` or ``heldout``, each to the side that stays better balanced.

    The walk is sequential, over a status histogram for each page on the driver, so more than ``most_urls`` pages raise;
    ``stratified_split`` is for sets of any size. Cases are joined back to their page's side.
    """
    hist = cases.groupBy("url", "expected_status").agg(F.count("*").alias("n")).limit(8 * most_urls + 1).collect()
    pages: dict[str, Counter] = {}
    for r in hist:
        pages.setdefault(r["url"], Counter())[r["expected_status"]] = r["n"]
    if len(pages) > most_urls or len(hist) > 8 * most_urls:
        raise ValueError(f"more than {most_urls} pages: use stratified_split")
    statuses = sorted({s for c in pages.values() for s in c})
    rng = random.Random(seed)
    urls = sorted(pages)
    rng.shuffle(urls)
    sides = {"tune": Counter(), "heldout": Counter()}
    dealt = []
    for url in urls:
        tune = _imbalance(sides["tune"] + pages[url], sides["heldout"], statuses)
        held = _imbalance(sides["tune"], sides["heldout"] + pages[url], statuses)
        side = "tune" if tune < held or (tune == held and rng.random() < 0.5) else "heldout"
        sides[side] += pages[url]
        dealt.append((url, side))
    return cases.select("id", "url").join(cases.sparkSession.createDataFrame(dealt, "url string, side string"), "url").select("id", "url", "side")


def stratified_split(cases: DataFrame, seed: str = "42") -> DataFrame:
    """``id, url, side`` for sets of any size: pages with the same status histogram are dealt in turn, in an order that a
    hash of seed and URL gives, so each side gets half of every kind of page. Nothing reaches the driver."""
    counts = [F.count_if(F.col("expected_status") == s) for s in K.STATUSES]
    pages = cases.where("url is not null").groupBy("url").agg(F.concat_ws(",", *[c.cast("string") for c in counts]).alias("kind"))
    order = numbered(pages.withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), "url"))), "place", "kind", "h", "url")
    dealt = order.select("url", F.when(F.col("place") % 2 == 0, F.lit("tune")).otherwise(F.lit("heldout")).alias("side"))
    return cases.select("id", "url").join(dealt, "url").select("id", "url", "side")


def partition_problems(split: DataFrame, cases: DataFrame) -> DataFrame:
    """``problem, what`` of a split that isn't one: cases on no side or on several, sides of unknown cases, pages cut in two."""
    sides = split.groupBy("id").agg(F.count_distinct("side").alias("n"))
    met = cases.select("id").distinct().withColumn("known", F.lit(True)).join(sides, "id", "full_outer")
    problem = F.when(F.col("known").isNull(), F.lit("unknown-case")).when(F.col("n").isNull(), F.lit("case-on-no-side")).when(F.col("n") > 1, F.lit("case-on-both-sides"))
    cut = split.groupBy("url").agg(F.count_distinct("side").alias("n")).where("n > 1").select(F.lit("page-on-both-sides").alias("problem"), F.col("url").alias("what"))
    return met.select(problem.alias("problem"), F.col("id").alias("what")).where("problem is not null").unionByName(cut)


def partition_summary(split: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases, pages and status counts of each side."""
    d = split.join(cases.select("id", "expected_status"), "id")
    return d.groupBy("side").agg(F.count("*").alias("n_cases"), F.count_distinct("url").alias("n_urls"), *[F.count_if(F.col("expected_status") == s).alias(s) for s in K.VERDICTS])


def baselines(cases: DataFrame, tiers: DataFrame | None = None, seed: int = 42, most_cases: int = 1_000_000) -> DataFrame:
    """Accuracy and Wilson bounds of trivial rules.

    Constant rules come from one status count. The two that draw at random repeat a generator's draws over statuses in
    order of their id, on the driver, so more than ``most_cases`` raise; ``hashed_baselines`` draws by a hash of the id.
    """
    spark = cases.sparkSession
    rows = [(r["name"], r["correct"], r["n"]) for r in exact_baselines(cases, tiers).collect()]
    if rows and rows[0][2] > most_cases:
        raise ValueError(f"more than {most_cases} cases: use hashed_baselines")
    expected = [r["expected_status"] for r in cases.select("id", "expected_status").orderBy("id").collect()]  # most_cases rows
    counts = Counter(expected)
    if expected:
        rng = random.Random(seed)
        names, weights = list(counts), list(counts.values())
        rows.append(("random_by_distribution", sum(rng.choices(names, weights=weights)[0] == e for e in expected), len(expected)))
        rng = random.Random(seed)
        order = sorted(counts.items())
        total, hits = len(expected), 0
        for e in expected:
            r, reach, said = rng.random(), 0, order[-1][0]
            for s, c in order:
                reach += c
                if r < reach / total:
                    said = s
                    break
            hits += said == e
        rows.append(("status_prior_random", hits, total))
    return _with_bounds(spark.createDataFrame(rows, "name string, correct long, n long"))


def hashed_baselines(cases: DataFrame, tiers: DataFrame | None = None, seed: str = "42") -> DataFrame:
    """``bounded_baselines`` and a rule that draws a status with its share of the set, by a hash of seed and id: for sets of
    any size, the same whatever the order of rows."""
    counts = cases.groupBy("expected_status").agg(F.count("*").alias("c"))
    shares = counts.agg(F.array_sort(F.collect_list(F.struct(F.col("expected_status").alias("s"), "c"))).alias("shares"), F.sum("c").alias("total"))  # a row for each status
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "id")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    step = lambda acc, x: F.struct((acc["reach"] + x["c"]).alias("reach"), F.when(acc["said"].isNull() & (F.col("u") < (acc["reach"] + x["c"]) / F.col("total")), x["s"]).otherwise(acc["said"]).alias("said"))
    start = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(None).cast("string").alias("said"))
    d = cases.select("expected_status", u.alias("u")).crossJoin(F.broadcast(shares))  # one row
    said = F.aggregate("shares", start, step)["said"]
    drawn = d.agg(F.count_if(said == F.col("expected_status")).alias("correct"), F.count("*").alias("n")).select(F.lit("random_by_hash").alias("name"), "correct", "n")
    return _with_bounds(exact_baselines(cases, tiers).unionByName(drawn))


def exact_baselines(cases: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """``name, correct, n``: always supported, always unsupported, the majority status and, with tiers (``id,
    tier_reached``), supported just at tier 1. Cases without a tier count as wrong there."""
    counts = cases.groupBy("expected_status").agg(F.count("*").alias("c"))
    one = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.when(F.col("expected_status") == s, F.col("c"))), F.lit(0)).alias(a) for a, s in (("s", K.SUPPORTED), ("u", K.UNSUPPORTED))], F.coalesce(F.max("c"), F.lit(0)).alias("m"))
    out = one.select("n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("correct")) for name, c in (("always_supported", "s"), ("always_unsupported", "u"), ("majority_class", "m"))])).alias("x")).select("x.name", "x.correct", "n")
    if tiers is not None:
        d = cases.select("id", "expected_status").join(tiers.select("id", "tier_reached"), "id", "left")
        said = F.when(F.col("tier_reached") == 1, F.lit(K.SUPPORTED)).when(F.col("tier_reached").isNotNull(), F.lit(K.UNSUPPORTED))
        out = out.unionByName(d.agg(F.count_if(said == F.col("expected_status")).alias("correct"), F.count("*").alias("n")).select(F.lit("tier1_always_supported").alias("name"), "correct", "n"))
    return out


def _with_bounds(rows: DataFrame) -> DataFrame:
    low, high = wilson(F.col("correct"), F.col("n"))
    return rows.withColumn("accuracy", ratio(F.col("correct"), F.col("n"))).withColumn("low", low).withColumn("high", high)


def bounded_baselines(cases: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    return _with_bounds(exact_baselines(cases, tiers))


def uncertainty(records: DataFrame, cases: DataFrame) -> DataFrame:
    """Wilson bounds overall and for the two safety categories, as ``scope, correct, total, low, high``."""
    scopes = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("category").isin("negation-flip", "entity-swap"), F.col("category"))), lambda s: s.isNotNull())).alias("scope")
    d = graded(records).select("match", scopes).groupBy("scope").agg(F.count_if("match").alias("correct"), F.count("*").alias("total"))
    low, high = wilson(F.col("correct"), F.col("total"))
    return d.withColumn("low", F.bround(low, 4)).withColumn("high", F.bround(high, 4))


def uncertainty_block(records: DataFrame, cases: DataFrame, confidence: float = 0.95, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """``part, scope, correct, total, low, high`` of one run in one table.

    Parts: ``wilson`` over all records and the safety categories; ``clusters``, the bootstrap over pages, where some page
    has several records; ``confidence``, agreement by the labeller's confidence (its bounds are Wilson's too).
    """
    columns = ("part", "scope", "correct", "total", "low", "high")
    first = uncertainty(records, cases).withColumn("part", F.lit("wilson")).select(*columns)
    boot = bootstrap_interval(records, cases, confidence, resamples, seed)
    overall = agreement(records).select("correct", "total")
    clusters = boot.crossJoin(overall).where("n_clusters < total").select(F.lit("clusters").alias("part"), F.lit("all").alias("scope"), "correct", "total", F.bround("low", 4).alias("low"), F.bround("high", 4).alias("high"))  # one row each
    by = confidence_breakdown(records, cases)
    low, high = wilson(F.col("correct"), F.col("total"))
    levels = by.select(F.lit("confidence").alias("part"), F.col("labeler_confidence").alias("scope"), "correct", "total", F.bround(low, 4).alias("low"), F.bround(high, 4).alias("high"))
    return first.unionByName(clusters).unionByName(levels)


def throughput(runs: DataFrame, *keys: str) -> DataFrame:
    """``n_runs, mean_seconds, p50_seconds, pairs_per_second, peak_mb`` of timed runs (``seconds, pairs, peak_mb``)."""
    d = runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.avg("seconds").alias("mean_seconds"), F.median("seconds").alias("p50_seconds"), ratio(F.sum("pairs"), F.sum("seconds")).alias("pairs_per_second"), F.max("peak_mb").alias("peak_mb"))
    return d


def with_dead_links(authored: DataFrame, older: DataFrame, category: str = "dead-link") -> DataFrame:
    """Authored cases and the dead-link cases of an older set (those whose id isn't taken), in the columns of both."""
    shared = [c for c in authored.columns if c in older.columns]
    dead = older.where(F.col("category") == category).join(authored.select("id"), "id", "left_anti")
    return authored.select(*shared).unionByName(dead.select(*shared))
