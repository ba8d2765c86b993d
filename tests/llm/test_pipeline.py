import os

import pytest

import corpus_pipeline
from affinity.llm import secret_scan, simhash_trie
from affinity.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import docs

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_keep_the_columns_and_take_effect(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = frame.columns
    sizes = [frame.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.cut(stage(spark, frame, DATA), f"test-{name}")
        assert frame.columns == columns, name
        sizes.append(frame.count())
        if name == "near_duplicates":
            assert simhash_trie.near_duplicates(frame).where("doc_id <> component_id").isEmpty()
        if name == "secrets":
            assert secret_scan.find_secrets(frame).where("size(spans) > 0").isEmpty()
            assert sizes[-1] == sizes[-2]
    assert sizes[0] > sizes[1] > sizes[2] and sizes[4] <= sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, DATA)
    assert packed.select("doc_id").distinct().count() == sizes[4]


def test_stages_on_empty_and_null_documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    for rows in ([], [(1, None), (None, None), (2, ""), (2, ""), (3, "plain words here")]):
        frame = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, DATA).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {ORACLE_SQL[name]}")
    columns = [r[0] for r in con.execute("DESCRIBE want").fetchall()]
    want = sorted(con.execute("SELECT * FROM want").fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect())
    assert got == want
