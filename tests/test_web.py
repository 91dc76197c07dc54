"""Fetching, the command lines and models, on fakes."""

import json
import math

import pytest
from pyspark.sql import functions as F

from attesta import constants as K
from attesta import evaluate, service
from attesta.operators import evaluation as E
from attesta.operators import models as M
from attesta.operators.entailment import lexical_scorer
from attesta.sources import cases as C
from attesta.sources import pages as S
from attesta.sources import web as W

TEXT = "The red bridge opened in 1998 near Oslo and carries trains every day across the wide river valley."


def answers(*what):
    """An opener that gives one answer after the other, and the list of what was asked and slept."""
    log, left = [], list(what)

    def opener(url):
        log.append(url)
        got = left.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    return opener, log


@pytest.mark.parametrize("given, ok, status, error, waits", [
    ([(200, {"etag": "e"}, b"a\xff")], True, 200, None, []),
    ([(404, {}, b"x")], False, 404, "HTTP 404", []),
    ([ConnectionResetError("r"), (200, {}, b"b")], True, 200, None, [0.5]),
    ([TimeoutError("t")] * 3, False, None, "TimeoutError: t", [0.5, 1.5]),
    ([(429, {"retry-after": "7"}, b""), (503, {"retry-after": "soon"}, b""), (503, {}, b"")], False, 503, "HTTP 503", [7.0, 1.5]),
    ([(429, {"retry-after": "900"}, b""), (200, {}, b"c")], True, 200, None, [30.0]),
    ([(429, {"retry-after": "-1"}, b""), (301, {}, b"c")], True, 301, None, [0.5]),
])
def test_requests_are_retried(given, ok, status, error, waits):
    opener, asked = answers(*given)
    slept = []
    page = W.get_page("http://x/", opener, slept.append)
    assert (page["ok"], page.get("status_code"), page["error"], slept) == (ok, status, error, waits)
    assert len(asked) == len(given)
    if ok and status == 200 and not waits:
        assert page["html"] == "a�" and page["etag"] == "e"


def test_robots_files_are_read():
    rules = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /\n"
    assert not W.may_fetch(rules, "http://x/private/1") and W.may_fetch(rules, "http://x/p") and W.may_fetch(None, "http://x/private")
    assert W.robots_text("http://x", answers((404, {}, b"no"))[0]) is None and W.robots_text("http://x", answers(OSError("x"))[0]) is None


@pytest.mark.parametrize("url, bad", [("http://a/b", False), ("http://u:p@a:80/", False), ("http://[::1]:8/x", False), ("http://a:port/", True), ("http://[::1/x", True), ("http://a:123456/", True), ("page.html", False)])
def test_addresses(spark, url, bad):
    assert (spark.createDataFrame([(url,)], "url string").select(W.invalid_address(F.col("url"))).first()[0] is not None) == bad


def _site(url):
    if url.endswith("robots.txt"):
        return 200, {}, b"User-agent: *\nDisallow: /no\n"
    return (200, {}, b"fresh") if "good" in url else (500, {}, b"")


def _wait(seconds):
    raise AssertionError("nothing here is retried")


def test_the_order_of_the_fetch_rules(spark, tmp_path):
    (tmp_path / "in.html").write_text("local page")
    urls = ["http://h/good", "http://h/no/good", "http://h/bad", "http://H/kept", "http://h/old", "gopher://h/", "", "bad\0", str(tmp_path / "in.html"), str(tmp_path / "none.html"), "/etc/passwd", None, "http://h/good"]
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    cache = spark.createDataFrame([("http://h/kept", "from the cache", "2024-01-01 12:00:00"), ("http://h/old", "stale", "2023-12-01 00:00:00"), ("/etc/passwd", "leak", "2024-01-01 23:00:00")], "norm_url string, html string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    out = {r["url"]: r for r in W.dispatched(spark.createDataFrame([(u,) for u in urls], "url string"), opener=_site, sleep=_wait, cache=cache, now=now, roots=(str(tmp_path),)).collect()}
    assert set(out) == {u for u in urls if u is not None}
    html = {u: r["html"] for u, r in out.items() if r["ok"]}
    assert html == {"http://h/good": "fresh", "http://H/kept": "from the cache", str(tmp_path / "in.html"): "local page"}
    error = {u: r["error"] for u, r in out.items() if not r["ok"]}
    assert error == {"http://h/no/good": "blocked by robots.txt", "http://h/bad": "HTTP 500", "http://h/old": "HTTP 500", "gopher://h/": "unsupported scheme gopher", "": "not a URL", "bad\0": "not a URL", str(tmp_path / "none.html"): "no such file", "/etc/passwd": "no such file"}


def test_probabilities_of_labels_by_name():
    labels = {0: "CONTRADICTION", 1: "neutral", 2: "Entailment"}
    ent, con = M.probabilities([1.0, 2.0, 3.0], labels)
    total = sum(map(math.exp, (1, 2, 3)))
    assert math.isclose(ent, math.exp(3) / total) and math.isclose(con, math.exp(1) / total)
    assert M.probabilities([2.0, 0.0], {0: "entailment", 1: "not_entailment"})[1] == 0.0
    assert math.isclose(M.probabilities([0.0, 2.0], {0: "not_entailment", 1: "entailment"})[0], math.exp(2) / (1 + math.exp(2)))
    assert M.probabilities(0.0, None) == M.probabilities([0.0], {0: "x"}) == (0.5, 0.0)
    assert math.isclose(M.probabilities([5.0, 1.0, 1.0], None)[0], M.softmax([5.0, 1.0, 1.0], 0)) and M.sigmoid(-800.0) == 0.0
    assert math.isclose(M.probabilities([1.0, 2.0, 3.0], {7: "entailment", 9: "contradiction"})[0], math.exp(1) / total)


def test_models_are_loaded_once_and_fail_at_once(monkeypatch):
    calls = []

    def loader(name):
        calls.append(name)
        return (lambda pairs: [[len(p), len(h), 0.0] for p, h in pairs]), {0: "entailment", 1: "contradiction", 2: "neutral"}

    model = M.load_model("m1", loader)
    assert M.load_model("m1", loader) is model and calls == ["m1"]
    assert model.predict([]) == [] and len(model.predict([("claim", "premise")] * 20)) == 20
    assert model.predict([("c", "long premise")])[0][0] > 0.99  # the premise is read first

    def broken(name):
        raise OSError("no such model")

    with pytest.raises(M.ModelError, match="no such model"):
        M.named_scorer("m2", broken)
    monkeypatch.setattr(M, "model_available", lambda *a: False)
    with pytest.raises(M.ModelError, match="not installed"):
        M.load_model("other")


def test_names_and_paths(tmp_path, monkeypatch):
    assert M.model_name(" a ", {K.ENV_MODEL: "b"}) == "a" and M.model_name("", {K.ENV_MODEL: " b"}) == "b" and M.model_name(None, {}) == K.DEFAULT_MODEL
    assert M.is_local_path(str(tmp_path)) and M.is_local_path("./x") and not M.is_local_path("owner/model")
    assert service.chosen_scorer(False, None) is None and service.chosen_scorer(None, "lexical") is lexical_scorer
    monkeypatch.setenv(K.ENV_MODEL, "lexical")
    assert service.chosen_scorer(True, None) is lexical_scorer


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in.md").write_text("The red bridge opened in 1998 [1].\n\n## Sources\n1. http://h/good\n")
    pages = str(tmp_path / "pages")
    spark.createDataFrame([("http://h/good", f"<p>{TEXT}</p>")], "url string, html string").write.parquet(pages)
    assert service.main([str(tmp_path / "in.md"), "--pages", pages, "--json", "--no-nli"]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["supported"] == 1 and "entailment tier is off" in said.err
    assert service.main([str(tmp_path / "in.md"), "--pages", pages, "--nli-model", "/no/such/model"]) == 2
    assert service.main([str(tmp_path / "none.md"), "--pages", pages, "--no-nli"]) == 2


def test_fetched_pages_are_kept(spark, tmp_path):
    cites = spark.createDataFrame([("http://h/good",), ("http://h/bad",)], "url string")
    first = service.cited_pages(spark, cites, str(tmp_path), _site)
    assert {r["url"]: r["ok"] for r in first.collect()} == {"http://h/good": True, "http://h/bad": False}

    def gone(url):
        raise OSError("offline")

    again = {r["url"]: r["ok"] for r in service.cited_pages(spark, cites.where("url like '%good'"), str(tmp_path), gone).collect()}
    assert again == {"http://h/good": True}


def cases_file(tmp_path):
    rows = [{"id": str(i), "category": ["verbatim-supported", "negation-flip", "entity-swap"][i % 3], "expected_status": ["supported", "unsupported", "unsupported"][i % 3], "labeler_confidence": "high", "url": f"http://p/{i // 3}", "claim": TEXT if i % 3 == 0 else "Purple whales sing opera", "notes": ""} for i in range(24)]
    (tmp_path / "set.json").write_text(json.dumps(rows))
    return str(tmp_path / "set.json")


def test_evaluation_commands(spark, tmp_path):
    cases, pages, out = cases_file(tmp_path), str(tmp_path / "pages"), str(tmp_path / "results" / "a.json")
    spark.createDataFrame([(f"http://p/{i}", f"<p>{TEXT}</p>") for i in range(8)], "url string, html string").write.parquet(pages)
    assert evaluate.main(["run", "--set", cases, "--pages", pages, "--out", out, "--no-nli"]) == 0
    body = json.loads(open(out).read())
    assert body["total"] == 24 and body["matched"] == 24 and len(body["records"]) == 24
    assert evaluate.main(["run", "--set", cases, "--pages", pages, "--out", str(tmp_path / "b.json"), "--no-nli", "--compare", str(tmp_path / "results")]) == 0
    assert json.loads(open(tmp_path / "b.json").read())["compared"]["mcnemar"][0]["p_value"] == 1.0
    for more in ([], ["--stratified"]):
        assert evaluate.main(["split", "--set", cases, "--out", str(tmp_path / "s.json"), *more]) == 0
        split = json.loads(open(tmp_path / "s.json").read())
        assert split["problems"] == [] and sum(r["n_cases"] for r in split["summary"]) == 24
    assert evaluate.main(["ablation", "--set", cases, "--pages", pages, "--out", str(tmp_path / "t.json"), "--nli-model", "lexical"]) == 0
    assert {r["config"] for r in json.loads(open(tmp_path / "t.json").read())["configs"]} == set(evaluate.CONFIGS)
    assert evaluate.main(["run", "--set", cases]) == 2


def test_cases_and_results_are_read(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.txt").write_text("text of one")
    assert [tuple(r) for r in C.read_page_texts(spark, str(tmp_path / "texts")).collect()] == [("one", "text of one")]
    for name, said in (("2024-01.json", "ambiguous"), ("2024-02.json", "supported")):
        (tmp_path / name).write_text(json.dumps({"records": [{"id": "1", "predicted": said}]}))
    assert C.latest_run(spark, str(tmp_path / "*.json")).first()["predicted"] == "supported"
    assert C.read_cases(spark, cases_file(tmp_path)).count() == 24


def test_bounds_are_raised_and_the_others_take_over(spark):
    cases = spark.createDataFrame([(str(i), f"http://p/{i // 2}", ["supported", "unsupported"][i % 2], "c", "high") for i in range(40)], "id string, url string, expected_status string, category string, labeler_confidence string")
    with pytest.raises(ValueError, match="stratified_split"):
        E.split_by_url(cases, most_urls=5)
    with pytest.raises(ValueError, match="hashed_baselines"):
        E.baselines(cases, most_cases=5)
    split = E.stratified_split(cases)
    assert E.partition_problems(split, cases).count() == 0
    assert {r["side"]: r["n"] for r in split.groupBy("side").agg(F.count_distinct("url").alias("n")).collect()} == {"tune": 10, "heldout": 10}
    records = cases.select("id", "category", F.col("expected_status").alias("expected"), F.lit("supported").alias("predicted"), F.lit(1).alias("tier_reached"))
    block = {(r["part"], r["scope"]): r for r in E.uncertainty_block(records, cases).collect()}
    assert block["wilson", "all"]["correct"] == 20 and block["clusters", "all"]["low"] == block["clusters", "all"]["high"] == 0.5 and ("confidence", "high") in block
    alone = E.uncertainty_block(records.where("id < 1"), cases)
    assert "clusters" not in {r["part"] for r in alone.collect()}


def test_local_pages_follow_the_policy(spark, tmp_path):
    (tmp_path / "a.html").write_text("x")
    with pytest.raises(FileNotFoundError):
        S.read_local(spark, str(tmp_path))
