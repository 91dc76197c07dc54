"""Extraction and the verification plan, end to end on small documents."""

import json

import pytest
from pyspark.sql import functions as F

from attesta import service
from attesta.functions.stats import cluster_bootstrap, mcnemar, mcnemar_exact
from attesta.operators import authoring as A
from attesta.operators import entailment as N
from attesta.operators import evaluation as E
from attesta.plans import report as R
from attesta.plans.verify import verify
from attesta.sources import documents as D
from attesta.sources import pages as S
from attesta.streaming import feeds

LONG = "The red bridge opened in 1998 near Oslo and carries trains every day across the wide river valley."
PAGES = [
    ("http://ok", f"<p>{LONG} Nothing else is said about it in this long text.</p>", True, None),
    ("http://wall", "<p>Subscribe to continue</p>" + "word " * 40, True, None),
    ("http://gone", "", False, "HTTP 404"),
    ("http://retracted", "<p>Retraction notice</p>" + "word " * 40, True, None),
    ("http://js", "<noscript>enable scripts</noscript>", True, None),
    ("http://both", "<p>paywall; this was retracted</p>", True, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "url string, html string, ok boolean, error string")


def cites(spark, rows):
    return spark.createDataFrame([(str(i), 0, "c", *r) for i, r in enumerate(rows)], D.CITATION)


def test_statuses(spark, pages):
    rows = [("HTTP://ok", "The red bridge opened in 1998", None, None), ("http://wall", "x", None, None), ("http://gone", "x", None, None), ("http://retracted", "x", None, None), ("http://js", "x", None, None),
            ("http://both", "x", None, None), ("http://nowhere", "x", None, None), ("http://ok", "Purple whales sing opera", None, None), ("http://ok", "The red bridge near Madrid opened in 1998", None, None), ("http://ok", "Green cats", None, "Green cats sleep")]
    out = {r["doc_id"]: r for r in verify(cites(spark, rows), S.described(pages)).collect()}
    assert [out[str(i)]["status"] for i in range(10)] == ["supported", "paywalled", "unreachable", "unsupported", "ambiguous", "paywalled", "unreachable", "unsupported", "unsupported", "supported"]
    assert [out[str(i)]["tier_reached"] for i in range(10)] == [2, 1, 1, 1, 2, 1, 1, 2, 2, 2]
    assert out["0"]["score"] == 1.0 and out["4"]["score"] is None and "Madrid" in out["8"]["notes"][-1]


def test_third_tier(spark, pages):
    rows = [("http://ok", "The red bridge opened in 1998", None, None), ("http://ok", "The red bridge not opened in 1998", None, None), ("http://js", "x", None, None)]
    out = {r["doc_id"]: r for r in verify(cites(spark, rows), S.described(pages), scorer=N.lexical_scorer).collect()}
    assert [out[str(i)]["status"] for i in range(3)] == ["supported", "unsupported", "ambiguous"]
    assert [out[str(i)]["tier_reached"] for i in range(3)] == [3, 3, 2]


def test_model_scorer_is_fed_pairs(spark, pages):
    scorer = N.model_scorer(lambda: lambda pairs: [(0.65, 0.1) for _ in pairs])
    r = verify(cites(spark, [("http://ok", "The red bridge opened", None, None)]), S.described(pages), scorer=scorer).first()
    assert (r["status"], r["tier_reached"], r["score"]) == ("ambiguous", 3, 0.65)


@pytest.mark.parametrize(("overlap", "ent", "con", "pooled", "located", "want"), [
    ("supported", 0.7, 0.4999, 0.0, True, ("supported", 3)), ("supported", 0.69, 0.0, None, True, ("ambiguous", 3)), ("supported", 0.9, 0.5, 0.0, True, ("unsupported", 3)),
    ("supported", 0.9, 0.0, 0.5, True, ("unsupported", 3)), ("ambiguous", 0.3, 0.0, 0.9, True, ("ambiguous", 3)), ("supported", None, None, None, True, ("supported", 2)), ("supported", 0.9, 0.0, 0.0, False, ("ambiguous", 3)),
])
def test_bands(spark, overlap, ent, con, pooled, located, want):
    d = lambda v: F.lit(v).cast("double")
    r = spark.range(1).select(N.applied(F.lit(overlap), F.array().cast("array<string>"), d(ent), F.lit(located), d(con), d(pooled)).alias("a")).first()["a"]
    assert (r["status"], r["tier_reached"]) == want


def test_markdown_and_json_service(spark, pages):
    text = "The red bridge opened in 1998 [1]. Unknown [7].\n\n## Sources\n1. http://ok\n"
    got = service.verify_markdown(spark, text, pages)
    assert got["total"] == 1 and got["supported"] == 1 and got["dropped_markers"][0]["marker"] == "[7]"
    assert "Decision: PASS" in R.rendered(got) and R.exit_status(got, strict=True) == 0
    bad = service.verify_citations(spark, [{"claim": "x", "citation": "nokey"}], pages)
    assert "neither a URL" in bad["error"]
    good = service.verify_citations(spark, json.dumps([{"claim": "The red bridge", "citation": "http://ok", "id": "z"}]), pages)
    assert good["verdicts"][0]["citation_id"] == "z"


def test_empty_inputs(spark, pages):
    empty = spark.createDataFrame([], D.CITATION)
    assert verify(empty, S.described(pages)).count() == 0
    from attesta.operators.verdicts import rollup

    r = rollup(verify(empty, S.described(pages))).first()
    assert (r["total"], r["pass_rate"]) == (0, 0.0)


def test_load_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("See it [x](pages/p.html).")
    (tmp_path / "b.json").write_text('{"citations": [{"claim": "c", "citation": "k"}], "sources": {"k": "http://k"}}')
    rows = {r["url"]: r["claim"] for r in D.load(spark, str(tmp_path))[0].collect()}
    assert rows == {f"{tmp_path}/pages/p.html": "See it [x](pages/p.html).", "http://k": "c"}


def test_keep_tail(spark):
    docs = spark.createDataFrame([("d", "A.\n\n## Sources\n1. http://a\n\n## Next\nlate [1].")], "doc_id string, body string")
    assert D.extract(docs)[0].count() == 0 and D.extract(docs, keep_tail=True)[0].count() == 1


def test_local_policy(tmp_path):
    inside = tmp_path / "in"
    inside.mkdir()
    (tmp_path / "link").symlink_to("/etc")
    assert S.allowed_local(str(inside / "x"), [str(inside)]) and not S.allowed_local(f"{inside}/../y", [str(inside)])
    assert not S.allowed_local(str(tmp_path / "link/passwd"), [str(tmp_path)]) and S.allowed_local("/etc/x", [], True)


def test_fetch_isolates_failures(spark):
    def get(url):
        if "bad" in url:
            raise TimeoutError("slow")
        return {"html": "x", "status_code": 200}

    urls = spark.createDataFrame([("http://a",), ("http://bad",), ("ftp://c",), (None,)], "url string")
    out = {r["url"]: (r["ok"], r["error"]) for r in S.fetched(urls, get).collect()}
    assert out["http://a"] == (True, None) and out["http://bad"][0] is False and "unsupported" in out["ftp://c"][1] and out[None][0] is False


def test_statistics(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in zip("sp", mcnemar(F.lit(59), F.lit(7)), strict=True)]).first()
    assert abs(r["p"] / mcnemar_exact(59, 7)[1] - 1) < 1e-9 and mcnemar_exact(0, 0) == (0.0, 1.0)
    assert cluster_bootstrap([], []) == (0.0, 0.0) and cluster_bootstrap([3], [3]) == (1.0, 1.0)
    assert cluster_bootstrap([1, 0, 2], [2, 1, 2]) == cluster_bootstrap([1, 0, 2], [2, 1, 2])
    with pytest.raises(ValueError):
        mcnemar_exact(-1, 0)


def test_split_keeps_pages_together(spark):
    rows = [(str(i), f"http://{i % 7}", ["supported", "unsupported"][i % 2]) for i in range(40)]
    cases = spark.createDataFrame(rows, "id string, url string, expected_status string")
    a, b = E.split_by_url(cases).collect(), E.split_by_url(cases).collect()
    assert sorted(a) == sorted(b) and len(a) == 40 and len({(r["url"], r["side"]) for r in a}) == 7


def test_authored_cases_hold_what_they_claim(spark):
    body = " ".join(f"The {w} engine of Marston was built in {1900 + i} by people who are known for many fine works of that old town." for i, w in enumerate(["red", "blue", "green", "grey"]))
    pages = spark.createDataFrame([(1, "http://p", body), (2, "http://q", None)], "id long, url string, text string")
    got = A.with_ids(A.authored(pages, id_col="id", url_col="url", text_col="text"), "ind4-", "page_id", "k").orderBy("k").collect()
    kinds = [r["category"] for r in got]
    assert kinds == ["verbatim-supported"] * 2 + ["negation-flip"] * 2 + ["entity-swap"] * 2 + ["mixed-false-conjunct"]
    assert got[0]["id"] == "ind4-001" and all(r["claim"] in body for r in got[:2]) and all(r["claim"] not in body for r in got[2:])
    assert "Marlowe" in got[4]["claim"] and "Zenith" in got[5]["claim"] and " not " in got[2]["claim"]


def test_streams(spark, tmp_path, pages):
    rows = cites(spark, [("http://ok", "The red bridge opened", None, None)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    static = S.described(pages)
    static.write.parquet(str(tmp_path / "pages"))
    q = feeds.verdict_stream(stream, spark.read.parquet(str(tmp_path / "pages"))).writeStream.format("memory").queryName("verdicts_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("verdicts_out").first()["status"] == "supported"
