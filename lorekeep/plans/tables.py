"""The driver's tables as a knowledge graph: foreign keys are relations, other columns are values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(table: DataFrame, rows: int = 1_000_000) -> int:
    """How many tasks hold a stored table with about so many rows each: one for each core at least."""
    return max(table.sparkSession.sparkContext.defaultParallelism, math.ceil(table.count() / rows))


def seconds(time: Column) -> Column:
    """Seconds since 1970 with their fraction: times within one second stay apart."""
    return F.unix_micros(time.cast("timestamp")) / F.lit(1e6)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    g = Graph(spark)
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    ordered = {"begin": seconds(F.col("o_orderdate"))}
    # perspectives and confidences come from the data: discounts stand for doubt, return flags for whose view it is
    view = {"uncertain": F.col("l_discount") >= 0.05, "confidence": 1 - F.col("l_discount") * 5, "agent": F.when(F.col("l_returnflag") == "R", F.lit("returns"))}
    for name, table, s, o, frame in [
        ("placedBy", "orders", "o_orderkey", "o_custkey", {}), ("totalPrice", "orders", "o_orderkey", "o_totalprice", {}), ("status", "orders", "o_orderkey", "o_orderstatus", {}),
        ("priority", "orders", "o_orderkey", "o_orderpriority", {}), ("orderDate", "orders", "o_orderkey", "o_orderdate", ordered), ("hasNation", "customer", "c_custkey", "c_nationkey", {}),
        ("customerName", "customer", "c_custkey", "c_name", {}), ("segment", "customer", "c_custkey", "c_mktsegment", {}), ("balance", "customer", "c_custkey", "c_acctbal", {}),
        ("nationName", "nation", "n_nationkey", "n_name", {}), ("inRegion", "nation", "n_nationkey", "n_regionkey", {}), ("regionName", "region", "r_regionkey", "r_name", {}),
        ("locatedIn", "supplier", "s_suppkey", "s_nationkey", {}), ("supplierName", "supplier", "s_suppkey", "s_name", {}), ("partName", "part", "p_partkey", "p_name", {}),
        ("brand", "part", "p_partkey", "p_brand", {}), ("partSize", "part", "p_partkey", "p_size", {}), ("hasPart", "lineitem", "l_orderkey", "l_partkey", view), ("suppliedBy", "lineitem", "l_orderkey", "l_suppkey", view),
    ]:
        g.map(name, t[table], s, o, **frame)
    return g.sub_property("placedBy", "involves").sub_property("suppliedBy", "involves")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): customers and suppliers in nations, nations in regions, regions in the world."""
    def edge(table: str, kind: str, key: str, up_kind: str, up: str) -> DataFrame:
        return read(spark, sf_dir, table).select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("src"), F.concat(F.lit(f"{up_kind}:"), F.col(up)).alias("dst"))

    world = read(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey")).alias("src"), F.lit("world").alias("dst"))
    return edge("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(world)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o): parts and brands as classes and individuals, with sizes, names and what orders hold."""
    part, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    pid, brand, kind = F.concat(F.lit("part"), F.col("p_partkey")), F.col("p_brand"), F.concat(F.lit("T_"), F.col("p_type"))
    keys = ["l_orderkey", "l_partkey"]  # numbers are told apart before they are names, in tasks of a bounded number of rows
    held = line.select(*keys).repartition(tasks(line), *keys).distinct()
    rows = [
        part.select(pid.alias("s"), F.lit("type").alias("p"), brand.alias("o")), part.select(pid.alias("s"), F.lit("type").alias("p"), kind.alias("o")),
        part.select(brand.alias("s"), F.lit("subClassOf").alias("p"), F.lit("Branded").alias("o")).distinct(), part.select(kind.alias("s"), F.lit("subClassOf").alias("p"), F.lit("Typed").alias("o")).distinct(),
        part.select(F.explode(F.array(F.lit("Branded"), F.lit("Typed"))).alias("s"), F.lit("subClassOf").alias("p"), F.lit("Part").alias("o")).distinct(),
        part.select(pid.alias("s"), F.lit("size").alias("p"), F.col("p_size").cast("string").alias("o")),
        held.select(F.concat(F.lit("order"), F.col("l_orderkey")).alias("s"), F.lit("contains").alias("p"), F.concat(F.lit("part"), F.col("l_partkey")).alias("o")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
