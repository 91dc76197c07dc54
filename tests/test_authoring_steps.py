"""Authoring does its work once for each page."""

from pyspark.sql import functions as F

from attesta.operators import authoring as A


CUT = "(?<=[.!?])"  # where a text is cut into sentences


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_of_a_page_are_authored_from_once(spark):
    d = spark.createDataFrame([(1, "u", "x")], "page_id int, url string, text string")
    assert plan(A.authored(d, id_col="page_id", url_col="url", text_col="text")).count(CUT) == 1


def test_numbering_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def one(x):
        made.add(1)
        return x

    rows = spark.range(50, numPartitions=4).withColumn("k", F.udf(one, "long")(F.col("id")))
    assert sorted(r["id"] for r in A.with_ids(rows, "c-", "k").collect())[0] == "c-001" and made.value == 50
