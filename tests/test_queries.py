"""Every query of the knowledge graph against its SQL."""

import pytest

from lorekeep.operators import taxonomy
from lorekeep.plans import knowledge, language, patterns, reasoning, registry, tables  # noqa: F401
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    oracle.compare(registry.QUERIES[name](spark, oracle.FOLDER), con, registry.ORACLES[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["ask_conjunction"](spark, oracle.FOLDER)._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice" in plan and "EqualTo(n_name,NATION_7)" in plan and "o_orderpriority" not in plan.split("Physical Plan")[1]


@pytest.mark.parametrize("name", ["similarity_by_nation", "most_similar_of_all", "wu_palmer_similarity", "n_most_similar", "transitive_with_cycles"])
def test_query_where_nations_hold_several_suppliers(spark, name):
    folder = oracle.FOLDER.replace("sf0.001", "sf0.01")
    got = registry.QUERIES[name](spark, folder)
    oracle.compare(got, oracle.connect(folder), registry.ORACLES[name])
    nation = {f"s:{r.s_suppkey}": r.s_nationkey for r in spark.read.parquet(f"{folder}/supplier.parquet").collect()}
    shared = {a for a in nation if list(nation.values()).count(nation[a]) > 1}
    if name == "most_similar_of_all":
        assert shared and shared == {r.a for r in got.where("rank = 1").collect() if nation[r.a] == nation[r.b]}


def test_reach_in_cycles_holds_true_ids(spark):
    line = spark.read.parquet(f"{oracle.FOLDER}/lineitem.parquet")
    ids = {r.dst for r in registry.QUERIES["reach_in_cycles"](spark, oracle.FOLDER).collect()}
    assert ids <= {f"p:{r[0]}" for r in line.select("l_partkey").distinct().collect()} | {f"s:{r[0]}" for r in line.select("l_suppkey").distinct().collect()} and len(ids) > 60


@pytest.mark.parametrize("name", ["wu_palmer_similarity", "n_most_similar"])
def test_pairs_compared_do_not_grow_with_suppliers(spark, tmp_path, monkeypatch, name):
    for t in ("customer", "nation", "region"):
        spark.read.parquet(f"{oracle.FOLDER}/{t}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = spark.range(200).selectExpr("id AS s_suppkey", "CAST(least(id, 3) AS INT) AS s_nationkey")  # nations of one supplier, and one of 197
    rows.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    compared, whole = [], taxonomy.wu_palmer
    monkeypatch.setattr(taxonomy, "wu_palmer", lambda closure, pairs, root: compared.append(pairs.count()) or whole(closure, pairs, root))
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert compared[0] <= 4 * 4 * 2 * 4
    con = duckdb_of(tmp_path)
    oracle.compare(got, con, registry.ORACLES[name])


def test_tasks_of_a_chain_grow_with_rows_not_with_the_session(spark, monkeypatch):
    assert tables.tasks(spark.range(1000), 10) == 100 and tables.tasks(spark.range(10), 10) == spark.sparkContext.defaultParallelism
    for module in (tables, reasoning):
        monkeypatch.setattr(module, "tasks", lambda table: 37)
    plan = registry.QUERIES["property_chain"](spark, oracle.FOLDER)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert plan.count(", 37), REPARTITION_BY_NUM") == 3


@pytest.mark.parametrize("name, dealt", [("allen_relations", 4), ("overlap_join", 1), ("overlap_open", 1)])
def test_spans_are_dealt_once_for_both_sides(spark, name, dealt):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = registry.QUERIES[name](spark, oracle.FOLDER)
        oracle.compare(got, oracle.connect(), registry.ORACLES[name])
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ReusedExchange [") == 1 and plan.count("+- Exchange ") == dealt


def test_relations_of_orders_without_customer_or_times(spark, tmp_path):
    day = "TIMESTAMP_NTZ '2000-01-01' + make_dt_interval({})".format
    orders = [(1, "NULL", 0), (2, "NULL", 100), (3, 7, 0), (4, 7, 50), (5, 7, "NULL"), (6, 7, "NULL"), (7, 7, 10), (8, 8, 3), (9, 8, "NULL")]
    ships = [(1, 5), (2, 120), (3, 10), (4, 60), (5, 20), (6, "NULL"), (7, 50), (8, "NULL"), (9, 3)]
    for table, columns, rows in (
        ("orders", "o_orderkey, o_custkey, o_orderdate", [f"({k}L, CAST({c} AS BIGINT), {day(d)})" for k, c, d in orders]),
        ("lineitem", "l_orderkey, l_shipdate", [f"({k}L, {day(d)})" for k, d in ships]),
    ):
        spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})").coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    got = registry.QUERIES["allen_relations"](spark, str(tmp_path))
    oracle.compare(got, duckdb_of(tmp_path), registry.ORACLES["allen_relations"])
    assert {r.relation: r.n for r in got.collect()} == {"before": 2, "after": 2, "meets": 3, "met_by": 3}


def duckdb_of(folder):
    import duckdb

    con = duckdb.connect()
    for t in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}/*.parquet'")
    return con
