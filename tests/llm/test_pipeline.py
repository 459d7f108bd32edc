"""The registered corpus queries against their SQL, and the pipeline's stages one by one."""

import duckdb
import pytest

import corpus_pipeline
from steinlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == expected


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_runs_on_all_rows(spark, name):
    got = QUERIES[name](spark, SF)
    key, n = ("vec_id", 500) if "vec_id" in got.columns else ("doc_id", 200)
    assert {r[key] for r in got.select(key).collect()} == set(range(n))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    awkward = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 ... !", "en", "s", 9), (9004, docs.first().text, "en", "s", 1)], docs.schema)
    now = docs.unionByName(awkward)
    ids = [{r.doc_id for r in now.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.schema.simpleString() == docs.schema.simpleString(), name
        ids.append({r.doc_id for r in now.collect()})
    assert ids[0] - ids[1] == {9001, 9002, 9003}
    assert ids[4] <= ids[3] <= ids[2] <= ids[1]
    assert 9004 in ids[1] and 9004 not in ids[3]
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in last.collect()} == ids[4]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 100 < out.select("doc_id").distinct().count() < 200
