"""Golden cases of the text functions; each pins a rule."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import pages as P
from attesta.functions import registry
from attesta.functions import text as T
from attesta.functions import urls as U


def one(spark, make, *values):
    row = spark.createDataFrame([values], ", ".join(f"a{i} string" for i in range(len(values))))
    return row.select(make(*[F.col(f"a{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_terms(spark):
    assert sorted(one(spark, T.content_terms, "The cat's 3.12 a B x1 not")) == ["3.12", "cat's", "not", "x1"]
    assert sorted(one(spark, T.entity_terms, 'He saw "Two Words" and Paris in 1998')) == ["1998", "paris", "two", "two words", "words"]
    assert {r["term"]: r["weight"] for r in one(spark, T.term_weights, "Paris grows 7")} == {"paris": 2.0, "grows": 1.0, "7": 2.0}
    assert one(spark, T.content_terms, None) == [] and one(spark, T.content_terms, "") == []


def test_clean_claim(spark):
    assert one(spark, T.clean_claim, " A [see](u) \n [1] b. ") == "A see b."


def test_passages_pack_and_carry_antecedents(spark):
    a, b = "A" * 390 + ".", "It ends here now."
    assert one(spark, T.segment_passages, f"{a} {b}") == [a, f"{a} {b}"]
    assert one(spark, T.segment_passages, "It is good. It is also great. They agree.") == ["It is good. It is also great. They agree."]
    assert one(spark, T.segment_passages, f"{'B' * 399}. {'c' * 19}") == [f"{'B' * 399}. {'c' * 19}"]
    assert one(spark, T.segment_passages, f"{'B' * 399}. {'c' * 20}") == [f"{'B' * 399}.", "c" * 20]
    assert one(spark, T.segment_passages, "  ") == [] and one(spark, T.segment_passages, None) == []


def test_passages_agree_with_the_generator(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", T.segment_passages(F.col("text")).alias("p")).collect()
    assert all(list(registry.passages_of(r["text"])) == r["p"] for r in rows)


def test_clauses_take_the_longest_conjunction(spark):
    assert one(spark, T.compound_clauses, "A and also B") == ["A", "B"]
    assert one(spark, T.compound_clauses, "sand and land but not sea") == ["sand", "land", "not sea"]
    assert one(spark, T.compound_clauses, "") == []


def test_best_sentence_boosts_anaphors(spark):
    text = "Falcon rose. It flew well. Blue birds sing songs today."
    assert one(spark, T.best_sentence, "falcon flew", text) == "Falcon rose. It flew well."
    assert one(spark, T.best_sentence, "blue birds sing", "It went. Blue birds sing.") == "It went."


def test_verbatim_span(spark):
    claim = "One two three four five six seven eight nine ten."
    assert one(spark, T.verbatim_span, claim, "Say: ONE two, three four five six seven eight nine ten! End") == "ONE two, three four five six seven eight nine ten"
    assert one(spark, T.verbatim_span, "one two three four five six seven eight nine", claim) is None


def test_names_and_conflicts(spark):
    assert one(spark, T.ungrounded_names, "This Arnold Smith met Paris", "paris and smith") == ["Arnold Smith"]
    assert one(spark, T.ungrounded_names, "Arnold came", "") == []
    assert one(spark, T.slot_conflict, "The bridge opened in 1998", "The bridge opened in 1997")
    assert one(spark, T.slot_conflict, "The bridge did open", "The bridge did not open")
    assert not one(spark, T.slot_conflict, "The bridge opened", "Cats sleep")


def test_clip(spark):
    assert one(spark, T.clipped, "x" * 300) == "x" * 300
    assert one(spark, T.clipped, "y" * 298 + "  zz") == "y" * 298 + "…"


def test_urls(spark):
    assert one(spark, U.normalized, "HTTP://User@Ex.COM:80/Path?Q#F") == "http://user@ex.com:80/Path?Q#F"
    assert one(spark, U.authority, "http://u@h:1/x") == "u@h:1"
    assert [one(spark, U.url_from_line, x) for x in ("[T](http://a) more", "see http://b/c) x", "file.md.", "two words", "#x")] == ["http://a", "http://b/c", "file.md", None, None]
    assert [one(spark, U.retry_after, x) for x in ("5", "-1", "99", "soon", None)] == [5.0, None, 30.0, None, None]
    assert one(spark, U.anchored, "../b/./c.html", "/docs/a") == "/docs/b/c.html"


def test_pages(spark):
    assert one(spark, P.html_text, "<style>p{}</style><p>A <b>b</b></p><script>x</script>") == "A b"
    assert one(spark, P.table_prose, "| T |\n|---|---|\n| k | v |\nEnd") == "T. k was v. End"
    assert one(spark, P.has_paywall, '<form action="/login" method="post">') and not one(spark, P.has_paywall, '<form action="/design/author" method="post">')
    assert one(spark, P.has_retraction, "RETRACTED: x") and not one(spark, P.has_retraction, "not retractedly")


def test_registered_functions(spark):
    names = registry.register(spark)
    assert {"clean_claim", "html_text", "normalized_url", "segment"} <= set(names)
    assert spark.sql("select clean_claim('a [1] b') x").first()["x"] == "a b"
    assert [r["passage"] for r in spark.sql("select * from segment('One. Two.')").collect()] == ["One. Two."]


@pytest.mark.parametrize("z", [0, 5, 93, 108])
def test_wilson_known(spark, z):
    from attesta.functions.stats import wilson

    low, high = wilson(F.lit(z), F.lit(108))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert 0 <= r["a"] <= z / 108 + 1e-9 and z / 108 - 1e-9 <= r["b"] <= 1
    if z == 93:
        assert (round(r["a"], 4), round(r["b"], 4)) == (0.7834, 0.9140)
