"""Scalar functions, lists, terms and control of goals over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import builtins as fn
from lorekeep.operators import bindings, control
from lorekeep.plans.registry import query
from lorekeep.plans.tables import graph, read
from lorekeep.terms import Pattern, gt

P = Pattern


@query("""SELECT c_custkey AS c, (CASE WHEN b < 0 THEN ceil(b) ELSE floor(b) END)::BIGINT AS truncated, round_even(b, 0)::BIGINT AS rounded, floor(b)::BIGINT AS low, ceil(b)::BIGINT AS high, abs(b) AS size, CASE WHEN c_nationkey <> 0 THEN c_custkey % c_nationkey END AS rest,
CASE WHEN c_nationkey <> 0 THEN round(b / c_nationkey, 6) END AS part, round(sqrt(abs(b)), 6) AS root, round(ln(abs(b) + 1), 6) AS l, round(log10(abs(b) + 1), 6) AS l10, round(sin(b) + cos(b) * tan(b) + atan2(b, 2) + asin(c_nationkey / 30) + acos(c_nationkey / 30) + atan(b), 5) AS t, round(exp(c_nationkey / 10), 6) AS e,
greatest(b, 100) AS most, least(b, 100) AS least FROM (SELECT *, c_acctbal AS b FROM customer)""")
def arithmetic(spark, sf):
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    wave = F.sin(b) + F.cos(b) * F.tan(b) + F.atan2(b, F.lit(2.0)) + F.asin(n / 30) + F.acos(n / 30) + F.atan(b)
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("c"), fn.truncate(b).cast("long").alias("truncated"), fn.round_half_even(b).cast("long").alias("rounded"), F.floor(b).alias("low"), F.ceil(b).alias("high"), F.abs(b).alias("size"),
        fn.modulo(F.col("c_custkey"), n).alias("rest"), F.round(fn.divide(b, n.cast("double")), 6).alias("part"), F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.round(F.ln(F.abs(b) + 1), 6).alias("l"), F.round(F.log10(F.abs(b) + 1), 6).alias("l10"),
        F.round(wave, 5).alias("t"), F.round(F.exp(n / 10), 6).alias("e"), F.greatest(b, F.lit(100.0)).alias("most"), F.least(b, F.lit(100.0)).alias("least"),
    )


@query("""SELECT p_partkey AS p, length(p_name) AS n, upper(p_name) AS up, lower(p_brand) AS low, starts_with(p_name, 'red') AS red, p_brand || '/' || p_type AS joined, CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) END AS tail,
CASE WHEN ends_with(p_name, 'ring') THEN substr(p_name, 1, length(p_name) - 4) END AS head, try_cast(substr(p_brand, 7) AS DOUBLE) AS number, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || substr(w, 2)), '') AS camel FROM part""")
def atoms(spark, sf):
    name, brand = F.col("p_name"), F.col("p_brand")
    tail = fn.concat_right(F.lit("Brand#"), brand)
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("p"), F.length(name).cast("long").alias("n"), F.upper(name).alias("up"), F.lower(brand).alias("low"), name.startswith("red").alias("red"), F.concat_ws("/", brand, "p_type").alias("joined"),
        tail.alias("tail"), fn.concat_left(F.lit("ring"), name).alias("head"), fn.atom_number(tail).alias("number"), fn.camel_case(name).alias("camel"),
    )


@query("""SELECT p_partkey AS p, 'http://x.org/' || p_type || '#' AS ns, substr(p_brand, 7) AS name, 'x_' || p_name AS prefixed, substr(p_name, 5) AS cut FROM (SELECT p_partkey, p_type, p_brand, CASE WHEN starts_with(p_name, 'red ') THEN p_name ELSE 'abc ' || p_name END AS p_name FROM part)""")
def iris(spark, sf):
    part = read(spark, sf, "part")
    iri = F.concat(F.lit("http://x.org/"), "p_type", F.lit("#"), fn.remove_prefix(F.col("p_brand"), "Brand#"))
    name = F.when(F.col("p_name").startswith("red "), F.col("p_name")).otherwise(F.concat(F.lit("abc "), "p_name"))
    cut = fn.remove_prefix(fn.remove_prefix(name, "red "), "abc ")
    return part.select(F.col("p_partkey").alias("p"), fn.iri_namespace(iri).alias("ns"), fn.iri_name(iri).alias("name"), fn.ensure_prefix(name, "x_").alias("prefixed"), cut.alias("cut"))


@query("""WITH l AS (SELECT l_orderkey AS o, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT o, len(q) AS n, list_max(q) AS high, list_min(q) AS low, round(list_sum(q), 3) AS total, q[1] AS first, q[8] AS eighth, nullif(coalesce(list_position(q, 10.0), 0), 0) - 1 AS ten, list_contains(q, 10.0) AS has, array_to_string(list_sort(list_distinct(q)), ' ') AS sorted FROM l""")
def lists(spark, sf):
    q = F.col("q")
    lists = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("a")).select("o", F.col("a.l_quantity").alias("q"))
    return lists.select(
        "o", F.size(q).cast("long").alias("n"), F.array_max(q).alias("high"), F.array_min(q).alias("low"), F.round(fn.sum_list(q), 3).alias("total"), fn.nth0(q, F.lit(0)).alias("first"), fn.nth0(q, F.lit(7)).alias("eighth"),
        fn.index_of(q, F.lit(10.0)).cast("long").alias("ten"), F.array_contains(q, 10.0).alias("has"), F.array_join(fn.sort_list(q).cast("array<string>"), " ").alias("sorted"),
    )


@query("""SELECT vec_id, label, 3 AS n, embedding[2]::DOUBLE AS second, NULL::DOUBLE AS fourth, 'point' AS f FROM embeddings""")
def terms(spark, sf):
    e = F.col("embedding")
    t = fn.term("point", *(e[i].cast("double") for i in range(3)))
    return read(spark, sf, "embeddings").select("vec_id", "label", t.alias("t")).select("vec_id", "label", fn.arity(F.col("t")).alias("n"), fn.arg(F.col("t"), 2).alias("second"), fn.arg(F.col("t"), 4).alias("fourth"), fn.functor(F.col("t")).alias("f"))


@query("""SELECT event_id, try_cast(v AS DOUBLE) IS NOT NULL AS number, v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL AS atom, v IS NULL AS var FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN value::VARCHAR WHEN event_type = 'error' THEN NULL ELSE event_type END AS v FROM events)""")
def type_tests(spark, sf):
    v = F.when(F.col("event_type") == "click", F.col("value").cast("string")).when(F.col("event_type") != "error", F.col("event_type"))
    return read(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", fn.is_number(F.col("v")).alias("number"), fn.is_atom(F.col("v")).alias("atom"), F.col("v").isNull().alias("var"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT > 90")
def json_values(spark, sf):
    """A field of a JSON column as a predicate."""
    g = graph(spark, sf)
    events = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    return g.map("strength", events, "event_id", "k").match(P("?event_id", "strength", gt(90, "?k")))


@query("""SELECT p_partkey AS p, round((p_size * 0.0254 + 0 - 0) / 0.3048, 6) AS feet, round((p_size * (5.0 / 9) + 255.372222 - 273.15) / 1.0, 4) + 0.0 AS celsius FROM part""")
def units(spark, sf):
    size = F.col("p_size").cast("double")
    feet = fn.convert_unit(size, F.lit(0.0254), F.lit(0.0), F.lit(0.3048), F.lit(0.0))
    celsius = fn.convert_unit(size, F.lit(5.0 / 9), F.lit(255.372222), F.lit(1.0), F.lit(273.15))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.round(feet, 6).alias("feet"), (F.round(celsius, 4) + 0.0).alias("celsius"))


# --- control


def _orders(spark, sf):
    return control.match(graph(spark, sf).ask(P("?o", "placedBy", "?c"), P("?o", "totalPrice", "?p")))


def _customers(spark, sf):
    return graph(spark, sf).match(P("?c", "balance", "?b"))


@query("""SELECT c_custkey AS c, c_acctbal AS b, coalesce(string_agg(o_totalprice::VARCHAR, ' ' ORDER BY o_orderkey), '') AS prices FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY ALL""")
def findall(spark, sf):
    goal = control.conj(_orders(spark, sf), control.where(F.col("p") > 250000))
    found = control.findall(goal, F.col("p"), "prices", ["c"], ["o"])(_customers(spark, sf))
    return found.withColumn("prices", F.array_join(F.col("prices").cast("array<string>"), " "))


@query("SELECT o_custkey AS c, c_acctbal AS b, o_orderkey AS o, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def once(spark, sf):
    return control.once(_orders(spark, sf), ["c"], ["o"])(_customers(spark, sf)).select("c", "b", "o", "p")


@query("SELECT o_custkey AS c, c_acctbal AS b, o_orderkey AS o, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 3")
def limit_per_row(spark, sf):
    return control.limit(_orders(spark, sf), 3, ["c"], ["p", "o"])(_customers(spark, sf)).select("c", "b", "o", "p")


@query("SELECT c_custkey AS c, c_acctbal AS b, o_orderkey AS o, o_totalprice AS p FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON o_custkey = c_custkey")
def ignore(spark, sf):
    return control.ignore(_orders(spark, sf), ["c"], ["o"])(_customers(spark, sf)).select("c", "b", "o", "p")


@query("SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def negation_as_failure(spark, sf):
    return control.naf(control.conj(_orders(spark, sf), control.where(F.col("p") > 450000)), ["c"])(_customers(spark, sf))


@query("""SELECT c_custkey AS c, CASE WHEN o IS NOT NULL THEN b * 2 ELSE b + 2 END AS y FROM (SELECT c_custkey, c_acctbal AS b, min(o_orderkey) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 GROUP BY ALL)""")
def if_then_else(spark, sf):
    test = control.conj(_orders(spark, sf), control.where(F.col("p") > 450000))
    goal = control.if_then_else(test, control.let("y", F.col("b") * 2), control.let("y", F.col("b") + 2), ["c"], ["o"])
    return goal(_customers(spark, sf)).select("c", "y")


@query("SELECT c_custkey AS c, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'fair' ELSE 'poor' END AS class FROM customer")
def cut(spark, sf):
    """The first branch that succeeds suppresses those behind it."""
    b = F.col("b")
    goal = control.first_branch(
        control.conj(control.where(b > 5000), control.let("class", F.lit("rich"))), control.conj(control.where(b > 0), control.let("class", F.lit("fair"))), control.let("class", F.lit("poor")), key=["c"], order=["b"]
    )
    return goal(_customers(spark, sf)).select("c", "class")


@query("SELECT c_custkey AS c, 0 AS branch, c_acctbal + 5 AS x FROM customer UNION ALL SELECT c_custkey, 1, c_acctbal * 2 FROM customer WHERE c_acctbal < 100")
def branches_in_order(spark, sf):
    goal = control.disj(control.let("x", F.col("b") + 5), control.conj(control.where(F.col("b") < 100), control.let("x", F.col("b") * 2)), branch="branch")
    return goal(_customers(spark, sf)).select("c", "branch", "x")


@query("SELECT n_nationkey AS n, unnest(range(n_regionkey, 4)) AS i FROM nation")
def between(spark, sf):
    regions = graph(spark, sf).match(P("?n", "inRegion", "?r"))
    return control.between(F.col("r").cast("long"), F.lit(3).cast("long"), "i")(regions).select("n", "i")


@query("SELECT p_partkey AS p, unnest(string_split(p_name, ' ')) AS w FROM part")
def member(spark, sf):
    parts = graph(spark, sf).match(P("?p", "partName", "?n")).withColumn("ws", F.split("n", " "))
    return control.member("ws", "w")(parts).select("p", "w")


@query("SELECT c_custkey AS c, c_nationkey AS n FROM customer WHERE c_nationkey = 3")
def unification(spark, sf):
    """A variable bound twice must agree."""
    nations = graph(spark, sf).match(P("?c", "hasNation", "?n"))
    return bindings.bind(nations, "n", F.lit(3))


@query("""SELECT c_nationkey AS n, count(*) AS orders, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS spread, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def aggregate_by(spark, sf):
    goal = control.conj(_orders(spark, sf), control.match(graph(spark, sf).match(P("?c", "hasNation", "?n"))))
    grouped = control.aggregate(goal, ["n"], orders=F.count("*"), mean=F.round(F.avg("p"), 4), spread=F.round(F.stddev_samp("p"), 4), customers=F.countDistinct("c"))
    return grouped(_customers(spark, sf))


@query("""SELECT n_regionkey AS r, n_nationkey AS n, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def rollup(spark, sf):
    found = graph(spark, sf).ask(P("?c", "balance", "?b"), P("?c", "hasNation", "?n"), P("?n", "inRegion", "?r"))
    return found.rollup("r", "n").agg(F.count("*").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))


@query("SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube(spark, sf):
    return graph(spark, sf).ask(P("?o", "priority", "?p"), P("?o", "status", "?s")).cube("p", "s").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand AS b FROM part")
def distinct_values(spark, sf):
    return graph(spark, sf).match(P("?p", "brand", "?b")).select("b").distinct()


@query("SELECT o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sorted_report(spark, sf):
    """A report of ten, as the operator's limit says."""
    return graph(spark, sf).match(P("?o", "totalPrice", "?p")).orderBy(F.desc("p"), "o").limit(10)


@query("""SELECT 'order without date' AS issue, count(*) AS n FROM orders WHERE o_orderdate IS NULL UNION ALL SELECT 'customer without order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'part never sold', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def validation(spark, sf):
    """What ought to be stated and isn't: anti-joins, one a check."""
    g = graph(spark, sf)
    checks = [
        ("order without date", g.match(P("?o", "status", "?_")).select("o"), g.match(P("?o", "orderDate", "?_d"))),
        ("customer without order", g.match(P("?c", "customerName", "?_")).select("c"), g.match(P("?o", "placedBy", "?c"))),
        ("part never sold", g.match(P("?p", "partName", "?_")).select("p"), read(spark, sf, "lineitem").select(F.col("l_partkey").alias("p"))),
    ]
    return bindings.union(*(bindings.negation(every, some).agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n") for name, every, some in checks))
