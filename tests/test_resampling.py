"""Seeded and folded resampling, splits and baselines against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attesta.functions.stats import cluster_bootstrap, folded_bootstrap, mcnemar, mcnemar_exact
from attesta.operators import authoring as A
from attesta.operators import evaluation as E
from attesta.operators import overlap as O

STATUSES = ["supported", "unsupported", "ambiguous"]


def made_cases(n, seed=1):
    rng = random.Random(seed)
    return [(f"c{i:03}", f"http://p/{rng.randrange(n // 3)}", rng.choices(STATUSES, [5, 3, 1])[0]) for i in range(n)]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(made_cases(90), "id string, url string, expected_status string")


def test_split_walks_as_described(cases):
    pages = {}
    for _, url, status in made_cases(90):
        pages.setdefault(url, Counter())[status] += 1
    every = sorted({s for c in pages.values() for s in c})

    def gap(a, b):
        n, m = sum(a.values()), sum(b.values())
        return (abs(n - m) / (n + m) if n + m else 0) + sum(abs((a[s] / n if n else 0) - (b[s] / m if m else 0)) for s in every)

    rng = random.Random(42)
    order = sorted(pages)
    rng.shuffle(order)
    tune, held, side = Counter(), Counter(), {}
    for url in order:
        a, b = gap(tune + pages[url], held), gap(tune, held + pages[url])
        side[url] = "tune" if a < b or (a == b and rng.random() < 0.5) else "heldout"
        (tune if side[url] == "tune" else held).update(pages[url])
    assert {(r["url"], r["side"]) for r in E.split_by_url(cases).collect()} == set(side.items())


def test_random_rules_draw_as_described(cases):
    expected = [s for _, _, s in sorted(made_cases(90))]
    counts = Counter(expected)
    rng = random.Random(42)
    by_share = sum(rng.choices(list(counts), weights=list(counts.values()))[0] == e for e in expected)
    rng = random.Random(42)
    hits = 0
    for e in expected:
        r, reach = rng.random(), 0
        for s in sorted(counts):
            reach += counts[s]
            if r < reach / 90:
                hits += s == e
                break
    got = {r["name"]: r["correct"] for r in E.baselines(cases).collect()}
    assert got["random_by_distribution"] == by_share and got["status_prior_random"] == hits
    assert got["majority_class"] == max(counts.values()) and got["always_supported"] == counts["supported"]


def test_folded_bootstrap_is_the_same_distribution():
    assert folded_bootstrap([]) == (0.0, 0.0) and folded_bootstrap([(3, 3, 5)]) == (1.0, 1.0)
    assert folded_bootstrap([(1, 1, 1), (0, 1, 1)], 0.4) == (0.5, 0.5) and folded_bootstrap([(1, 1, 1), (0, 1, 1)]) == (0.0, 1.0)
    rng = random.Random(3)
    kinds = Counter((rng.randrange(k + 1), k) for k in (rng.randrange(1, 6) for _ in range(600)))
    hits, sizes = ([x[i] for x, n in kinds.items() for _ in range(n)] for i in (0, 1))
    walk, folded = cluster_bootstrap(hits, sizes), folded_bootstrap([(c, k, n) for (c, k), n in kinds.items()])
    assert all(abs(a - b) < 0.003 for a, b in zip(walk, folded, strict=True))
    assert folded_bootstrap([(2, 3, 10**12), (0, 2, 10**12)], resamples=200)[0] > 0.39  # clusters cost nothing


def test_interval_by_both_ways(spark, cases):
    records = cases.select("id", F.lit("c").alias("category"), F.col("expected_status").alias("expected"), F.lit("supported").alias("predicted"))
    a, b = (E.bootstrap_interval(records, cases, walk=w).first() for w in (False, True))
    assert a["n_clusters"] == b["n_clusters"] and abs(a["low"] - b["low"]) < 0.03 and abs(a["high"] - b["high"]) < 0.03


@pytest.mark.parametrize("b, c", [(0, 0), (3, 3), (1, 9), (200, 260), (900, 1100), (5000, 5200), (40_000, 41_000), (10, 10_000)])
def test_paired_test_of_small_and_large_counts(spark, b, c):
    p = spark.createDataFrame([(b, c)], "b long, c long").select(mcnemar(F.col("b"), F.col("c"))[1]).first()[0]
    assert abs(p - mcnemar_exact(b, c)[1]) <= 1e-9 + 1e-6 * mcnemar_exact(b, c)[1] if b + c < 3000 else 0 <= p <= 1
    if (b, c) == (40_000, 41_000):
        assert abs(p - 0.000444) < 2e-5  # the normal approximation


def test_best_sources_without_all_pairs(spark):
    rng = random.Random(5)
    common, rare = [f"com{c}" for c in "abcdefgh"], [f"rare{i}x" for i in range(60)]
    claims = [(i, " ".join(rng.sample(common, rng.randrange(0, 4)) + rng.sample(rare, rng.randrange(0, 6)))) for i in range(60)]
    sources = [(i, " ".join(rng.sample(common, rng.randrange(0, 8)) + rng.sample(rare, rng.randrange(0, 12)))) for i in range(150)] + [(None, "coma comb"), (200, None)]
    sources += [(300 + i, f"{t} {t} more") for i, t in claims[:45]]  # most claims are in some source
    c, s = spark.createDataFrame(claims, "i long, t string"), spark.createDataFrame(sources, "j long, u string")
    how = {"claim_id": "i", "claim_text": "t", "source_id": "j", "source_text": "u"}
    every, some = O.scored_pairs(c, s.where("j is not null"), **how), O.leading_pairs(c, s, **how)
    assert {tuple(r) for r in O.best_sources(every).collect()} == {tuple(r) for r in O.best_sources(some).collect()}
    assert some.count() < 0.5 * every.count()


def test_first_made_looks_no_further(spark):
    d = spark.createDataFrame([([3, 1, 4, 1, 5, 0],)], "x array<int>")
    inverse = lambda v: F.when(v > 1, F.lit(60) / v).otherwise(F.when(v == 0, F.raise_error(F.lit("looked at")).cast("double")))
    assert d.select(A.first_made(F.col("x"), 3, inverse, "double").alias("y")).first()["y"] == [20.0, 15.0, 12.0]
