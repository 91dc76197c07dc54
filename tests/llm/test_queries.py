"""The registered queries and the pipeline's stages on the driver's smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from attesta.llm.oracles import oracle_sql
from attesta.llm.queries import queries
from tests.llm.test_operators import kept_words, near_components, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v
    rows = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    n = duck.execute("select count(*) from documents").fetchone()[0]
    assert len(rows) == n or name in ("op4_mixing", "op7_chat")
    if name in oracle_sql():
        found = duck.execute(oracle_sql()[name])
        have = [d[0] for d in found.description]
        assert sorted(have) == names and rows == sorted(repr([plain(r[have.index(c)]) for c in names]) for r in found.fetchall())


def test_pipeline(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = docs.dtypes
    seen = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.dtypes == kinds
        seen.append(docs.collect())
    start, good, unlike, cut, mixed, coded = seen
    assert {r["doc_id"] for r in good} <= {r["doc_id"] for r in start} and all(len(words_of(r["text"])) >= 50 for r in good)
    rows = [(r["doc_id"], r["text"]) for r in good]
    _, root = near_components(rows, 5)
    first = {r: min(i for (i, _), q in zip(rows, root, strict=True) if q == r) for r in set(root)}
    assert sorted(r["doc_id"] for r in unlike) == sorted(first.values())
    want = {i: k for i, _, _, k in kept_words([(r["doc_id"], r["text"]) for r in unlike])}
    assert {r["doc_id"]: " ".join(words_of(r["text"])) for r in cut} == want and all(r["n_chars"] == len(r["text"]) for r in cut)
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in cut} and len(coded) == len(mixed)
    assert Counter(r["doc_id"] for r in coded) == Counter(r["doc_id"] for r in mixed)
