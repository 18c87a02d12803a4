"""Registered queries against DuckDB or brute force, and the pipeline stage by stage."""

import corpus_pipeline
import pytest
from compare import connect, differences, oracle_rows, spark_rows
from test_dedup import naive_groups, naive_print
from test_quality_rules import brute

from thrustlog.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = spark_rows(queries.QUERIES[name](spark, SF_DIR))
    table = "pages" if name in ("op9_html_content", "op10_url_rules") else "documents"
    rows = duck.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if name != "op11_spelling":  # a row per word
        assert len(got[1]) >= rows if name == "op4_packing" else len(got[1]) == rows
    if name in queries.ORACLE:
        assert not differences(got, oracle_rows(duck, queries.ORACLE[name]))


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r["doc_id"] for r in docs.collect()]
        if name == "quality":
            expected = {i for i, t in before.items() if brute(t)["kept"]}
        elif name == "toxicity":
            expected = {i for i in before if i in set(after)}
            assert expected and sum(len(before[i].encode()) for i in expected) > 0.5 * sum(len(t.encode()) for t in before.values())
        elif name == "exact_dedup":
            last = {}
            for i, t in before.items():
                last[t] = max(i, last.get(t, i))
            expected = set(last.values())
        elif name == "simhash":
            label = naive_groups([naive_print(t) for t in before.values()]).tolist()
            first = {}
            for i, k in zip(before, label, strict=True):
                first[k] = min(i, first.get(k, i))
            expected = set(first.values())
        else:
            assert set(after) == set(before)
            break
        assert docs.columns == columns and sorted(after) == sorted(expected), name


def test_run_gives_the_last_stages_rows(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count()
