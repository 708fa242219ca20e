import os

import duckdb
import pytest

import corpus_pipeline
from quillspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")

COLUMNS = {
    "op1_tokens": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op3_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op4_topk": {"query_id", "rank", "vec_id", "score"},
    "op6_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert COLUMNS.get(name, set()) <= set(df.columns)
    rows = df.collect()
    assert rows
    if name in COLUMNS and name != "op4_topk":
        assert sorted(r["doc_id"] for r in rows) == list(range(200))
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        result = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        want = [tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()]
        assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in rows), key=repr) == sorted(want, key=repr)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == counts[-1]
    total = out.agg({"n_tokens": "sum"}).first()[0]
    last = out.orderBy("start", ascending=False).first()
    assert last["start"] + last["n_tokens"] == total


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
