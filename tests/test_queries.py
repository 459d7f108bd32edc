"""Every core query against its SQL, on the smallest tables."""

import duckdb
import pytest

from steinlake.plans import feature_queries, file_queries, graph_queries, kernel_queries, queries, sampling_queries, table_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
#: A hundred draws for each of 125,000 pairs in SQL, as in wild_bootstrap_complete: held against that query's draws below.
SLOW = {"mmd_test_full"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in queries.SQL if n not in SLOW])
def test_query_equals_its_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((plain(tuple(r)) for r in got.select(*columns).collect()), key=repr)
    found = sql.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((plain(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall()), key=repr)
    assert rows == expected


def test_all_queries_are_registered():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["m", "val", "quantile", "reject"]


def test_full_test_from_its_draws(spark):
    """The complete test is its statistic against the quantile of the draws that wild_bootstrap_complete returns."""
    import numpy as np

    out = queries.QUERIES["mmd_test_full"](spark, SF).first()
    val = queries.QUERIES["mmd_complete"](spark, SF).first()["val"]
    h0 = np.array([r.v for r in queries.QUERIES["wild_bootstrap_complete"](spark, SF).collect()])
    assert out.val == pytest.approx(val, abs=2e-6) and out.quantile == pytest.approx(np.quantile(h0, 0.95), abs=2e-6)
    assert out.p_value == pytest.approx(np.mean(h0 > val), abs=0.011) and out.reject == (out.val > out.quantile)


def test_max_occupancy_of_large_part_keys(spark, tmp_path):
    """Part keys beyond a million, of lines with equal quantities: as in the SQL."""
    con = duckdb.connect()
    con.execute(f"create table lineitem as select l_orderkey % 40 as l_orderkey, l_returnflag, l_partkey * 10007 as l_partkey, l_linenumber, (l_quantity::int % 3)::double as l_quantity from '{SF}/lineitem.parquet'")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = queries.QUERIES["max_occupancy"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.SQL["max_occupancy"]).fetchall())


def test_structure_forms_gathers_only_what_it_reads(spark):
    """Profiles and biases of residues that the result does not hold are not gathered by structure."""
    plan = queries.QUERIES["structure_forms"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "profile_weight" not in plan and "log_odds, " not in plan
