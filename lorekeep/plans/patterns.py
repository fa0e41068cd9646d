"""Patterns, joins, modality and writing over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep import graph as kg
from lorekeep.operators import bindings
from lorekeep.operators.taxonomy import reach
from lorekeep.plans.registry import query
from lorekeep.plans.tables import facts, geography, graph, read, seconds
from lorekeep.terms import Frame, Pattern, always, believe, eq, geq, gt, in_, know, leq, lt, neq, nin, prefix, regex, sometimes

P = Pattern
DAY = 86400.0


@query("""SELECT o_orderkey AS o, c_custkey AS c, n_nationkey AS n, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' AND o_totalprice > 100000""")
def ask_conjunction(spark, sf):
    return graph(spark, sf).ask(P("?o", "placedBy", "?c"), P("?c", "hasNation", "?n"), P("?n", "nationName", "NATION_7"), P("?o", "totalPrice", gt(100000, "?p")))


@query("""SELECT 'lt' AS op, count(*) AS n FROM part WHERE p_size < 10 UNION ALL SELECT 'leq', count(*) FROM part WHERE p_size <= 10 UNION ALL
SELECT 'gt', count(*) FROM part WHERE p_size > 10 UNION ALL SELECT 'geq', count(*) FROM part WHERE p_size >= 10 UNION ALL SELECT 'eq', count(*) FROM part WHERE p_size = 10 UNION ALL
SELECT 'neq', count(*) FROM part WHERE p_size <> 10 UNION ALL SELECT 'in', count(*) FROM part WHERE p_size IN (1, 5, 10) UNION ALL SELECT 'nin', count(*) FROM part WHERE p_size NOT IN (1, 5, 10)""")
def object_operators(spark, sf):
    g, out = graph(spark, sf), []
    for op in (lt(10), leq(10), gt(10), geq(10), eq(10), neq(10), in_([1, 5, 10]), nin([1, 5, 10])):
        out.append(g.match(P("?s", "partSize", op)).agg(F.count("*").alias("n")).select(F.lit(op.name).alias("op"), "n"))
    return bindings.union(*out)


@query("SELECT p_partkey AS s, p_name AS n FROM part WHERE starts_with(p_name, 'red') OR regexp_matches(p_name, 'ring$')")
def text_operators(spark, sf):
    g = graph(spark, sf)
    return bindings.union(g.match(P("?s", "partName", prefix("red", "?n"))), g.match(P("?s", "partName", regex("ring$", "?n")))).distinct()


@query("""SELECT o_orderkey AS s, o_custkey AS x FROM orders UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R' AND l_discount < 0.05""")
def sub_properties(spark, sf):
    return graph(spark, sf).match(P("?s", "involves", "?x"))


@query("SELECT DISTINCT c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def ask_unique(spark, sf):
    return graph(spark, sf).ask(P("?o", "status", "F"), P("?o", "placedBy", "?c"), P("?c", "hasNation", "?n"), unique=True).select("n").distinct()


@query("""SELECT c_custkey AS c, c_name AS name, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey""")
def optional_pattern(spark, sf):
    g = graph(spark, sf)
    urgent = g.ask(P("?o", "placedBy", "?c"), P("?o", "priority", "1-URGENT"))
    return bindings.optional(g.match(P("?c", "customerName", "?name")), urgent).select("c", "name", "o")


@query("SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def negated_pattern(spark, sf):
    g = graph(spark, sf)
    return bindings.negation(g.match(P("?c", "customerName", "?_")).select("c"), g.ask(P("?o", "placedBy", "?c"), P("?o", "status", "P")))


@query("SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'ATLANTIS')")
def negated_ground_pattern(spark, sf):
    g = graph(spark, sf)
    return bindings.negation(g.match(P("?c", "customerName", "?_")), g.match(P("?n", "nationName", "ATLANTIS"))).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS x, s_nationkey AS n FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000""")
def disjunction(spark, sf):
    g = graph(spark, sf)
    rich = g.ask(P("?x", "hasNation", "?n"), P("?x", "balance", gt(5000)))
    return bindings.union(g.match(P("?x", "locatedIn", "?n")), rich)


@query("""SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_acctbal > 0""")
def implication(spark, sf):
    """Customers for whom 'has an order above 400000' implies 'has a positive balance'."""
    g = graph(spark, sf)
    every = g.match(P("?c", "customerName", "?_")).select("c")
    dear = g.ask(P("?o", "placedBy", "?c"), P("?o", "totalPrice", gt(400000)))
    return bindings.union(bindings.negation(every, dear), bindings.semi(every, g.match(P("?c", "balance", gt(0))))).distinct()


@query("""SELECT s_suppkey AS s FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join(spark, sf):
    g = graph(spark, sf)
    nations = g.ask(P("?c", "segment", "BUILDING"), P("?c", "hasNation", "?n"))
    return bindings.semi(g.match(P("?s", "locatedIn", "?n")), nations).select("s")


@query("""SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def intersection_of_branches(spark, sf):
    g = graph(spark, sf)
    return bindings.intersection(g.match(P("?_", "hasNation", "?n")).select("n"), g.match(P("?_", "locatedIn", "?n")).select("n"))


@query("""SELECT a.n_nationkey AS n, r_regionkey AS r FROM nation a CROSS JOIN region""")
def cross_product(spark, sf):
    g = graph(spark, sf)
    return g.ask(P("?n", "nationName", "?_a"), P("?r", "regionName", "?_b")).select("n", "r")


@query("""WITH l AS (SELECT c_custkey AS c, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS n FROM customer), r AS (SELECT n_nationkey AS n, n_name AS name FROM nation WHERE n_regionkey = 1)
SELECT l.c, r.n, r.name FROM l JOIN r ON l.n IS NULL OR l.n = r.n""")
def maybe_bound_join(spark, sf):
    """A join on a variable that may be unbound on the left and then takes all values; the right side is a few nations."""
    g = graph(spark, sf)
    left = g.ask(P("?c", "hasNation", "?n"), P("?c", "balance", "?b")).withColumn("n", F.when(F.col("b") > 0, F.col("n"))).drop("b")
    right = g.ask(P("?n", "nationName", "?name"), P("?n", "inRegion", 1))
    return bindings.join(left, right, maybe=("n",))


@query("""SELECT c_custkey AS c, CASE WHEN c_acctbal > 5000 THEN 5000.0::DOUBLE ELSE c_acctbal END AS low, greatest(c_acctbal, 0.0) AS high, c_acctbal * 2 AS twice
FROM customer WHERE c_acctbal < 9000""")
def graph_builtins(spark, sf):
    df = bindings.compare(graph(spark, sf).match(P("?c", "balance", "?b")), F.col("b"), "less", F.lit(9000))
    df = bindings.bind(df, "low", F.least("b", F.lit(5000.0)))
    df = bindings.bind(bindings.bind(df, "high", F.greatest("b", F.lit(0.0))), "twice", F.col("b") * 2)
    return df.drop("b")


@query("""SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def path_query(spark, sf):
    g = graph(spark, sf)
    return g.ask(P("?c", "hasNation", "?n"), P("?n", "inRegion", "?r"), P("?r", "regionName", "?region")).groupBy("region").agg(F.count("*").alias("n"))


# --- modality


@query("SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_discount < 0.05 AND l_returnflag <> 'R'")
def modal_knowledge(spark, sf):
    return graph(spark, sf).match(P("?o", "hasPart", "?p", know()))


@query("SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' AND l_discount < 0.05")
def modal_knowledge_of_agent(spark, sf):
    return graph(spark, sf).match(P("?o", "hasPart", "?p", know(agent="returns")))


@query("SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' AND 1 - l_discount * 5 >= 0.8")
def modal_belief(spark, sf):
    return graph(spark, sf).match(P("?o", "hasPart", "?p", believe(agent="returns", confidence=0.8)))


@query("""SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE epoch(o_orderdate) <= 883612800""")
def modal_always(spark, sf):
    g = graph(spark, sf)
    return g.ask(P("?o", "orderDate", "?d", always(begin=883612800.0)), P("?o", "placedBy", "?c")).select("o", "c")


@query("""SELECT o_orderkey AS o FROM orders WHERE epoch(o_orderdate) <= 852076800""")
def modal_sometimes(spark, sf):
    return graph(spark, sf).match(P("?o", "orderDate", "?d", sometimes(begin=820454400.0, end=852076800.0))).select("o")


@query("""SELECT l_orderkey AS o, l_partkey AS p, l_discount >= 0.05 AS _uncertain, false AS _occasional, 1 - l_discount * 5 AS _confidence, NULL::DOUBLE AS _begin, NULL::DOUBLE AS _end
FROM lineitem WHERE l_returnflag <> 'R'""")
def answer_frames(spark, sf):
    return graph(spark, sf).match(P("?o", "hasPart", "?p", believe()), with_frame=True)


@query("""SELECT a.l_orderkey AS o, a.l_partkey AS p, b.l_suppkey AS s, a.l_discount >= 0.05 OR b.l_discount >= 0.05 AS _uncertain, false AS _occasional,
least(1 - a.l_discount * 5, 1 - b.l_discount * 5) AS _confidence, NULL::DOUBLE AS _begin, NULL::DOUBLE AS _end
FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_returnflag <> 'R' AND b.l_returnflag <> 'R'""")
def merged_frames(spark, sf):
    """Uncertain if a part is, with the least confidence of the parts."""
    g, view = graph(spark, sf), believe()
    return g.ask(P("?o", "hasPart", "?p", view), P("?o", "suppliedBy", "?s", view), with_frame=True)


# --- the store


def _store(spark, sf):
    """Orders' states as framed triples: valid from the order to 30 days later, graphs by priority."""
    o = read(spark, sf, "orders")
    day = seconds(F.col("o_orderdate")) / DAY
    rows = o.select(
        F.concat(F.lit("cust"), F.col("o_custkey")).alias("s"), F.lit("state").alias("p"), F.col("o_orderstatus").alias("o"), F.substring("o_orderpriority", 1, 1).alias("graph"),
        day.alias("begin"), (day + 30).alias("end"), (F.col("o_totalprice") > 400000).alias("uncertain"),
    )
    return kg.Graph(spark).tell(rows)


_STORE = """store AS (SELECT 'cust' || o_custkey AS s, 'state' AS p, o_orderstatus AS o, o_orderpriority[1] AS graph, epoch(o_orderdate) / 86400 AS b, epoch(o_orderdate) / 86400 + 30 AS e,
o_totalprice > 400000 AS uncertain FROM orders)"""


@query(f"WITH {_STORE} SELECT s, o FROM store WHERE graph IN ('1', '2', '3') AND NOT uncertain")
def graph_imports(spark, sf):
    g = _store(spark, sf).import_graph("1", "2").import_graph("2", "3")
    return g.match(P("?s", "state", "?o", Frame(graphs=("1",))))


@query(f"WITH {_STORE} SELECT s, p, count(*) AS n FROM store WHERE o = 'F' AND NOT uncertain GROUP BY s, p")
def variable_predicate(spark, sf):
    return _store(spark, sf).match(P("?s", "?p", "F")).groupBy("s", "p").agg(F.count("*").alias("n"))


@query(f"WITH {_STORE} SELECT s, count(*) AS n FROM store WHERE NOT uncertain AND b <= 10500 AND e >= 10470 GROUP BY s")
def stored_overlap(spark, sf):
    return _store(spark, sf).match(P("?s", "state", "?o", sometimes(begin=10470.0, end=10500.0))).groupBy("s").agg(F.count("*").alias("n"))


@query(f"WITH {_STORE} SELECT s, o, b AS t_begin, e AS t_end FROM store WHERE NOT (s IN (SELECT s FROM store WHERE o = 'P') AND o = 'P') AND graph <> '5'")
def forget_facts(spark, sf):
    g = _store(spark, sf)
    g = g.forget(g.triples.where("o = 'P'")).forget_origin("5")
    return g.triples.select("s", "o", F.col("begin").alias("t_begin"), F.col("end").alias("t_end"))


@query(f"""WITH {_STORE}, m AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY s, o, graph, uncertain ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM store),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY s, o, graph, uncertain ORDER BY b, e) AS run FROM m)
SELECT s, o, graph, uncertain, min(b) AS t_begin, max(e) AS t_end FROM r GROUP BY s, o, graph, uncertain, run""")
def merge_tell(spark, sf):
    """Facts of one key and flags whose intervals meet or overlap become one."""
    merged = kg.Graph(spark).merge_tell(_store(spark, sf).triples)
    return merged.triples.select("s", "o", "graph", "uncertain", F.col("begin").alias("t_begin"), F.col("end").alias("t_end"))


@query(f"WITH {_STORE} SELECT s, p, o, graph, uncertain, b AS t_begin, e AS t_end FROM (SELECT DISTINCT * FROM store)")
def reify_and_back(spark, sf):
    back = kg.from_reified(kg.to_reified(_store(spark, sf).triples))
    return back.select("s", "p", "o", "graph", "uncertain", F.col("begin").alias("t_begin"), F.col("end").alias("t_end"))


@query("""SELECT 'contains' AS p, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'size', count(*) FROM part UNION ALL SELECT 'type', 2 * count(*) FROM part
UNION ALL SELECT 'subClassOf', count(DISTINCT p_brand) + count(DISTINCT p_type) + 2 FROM part""")
def counters(spark, sf):
    return kg.Graph(spark).tell(facts(spark, sf)).counters()


@query("""SELECT 'part' || p_partkey AS x FROM part WHERE p_brand = 'Brand#7'""")
def instances_of_class(spark, sf):
    return kg.Graph(spark).tell(facts(spark, sf)).match(P("?x", "type", "Brand#7"))


@query("SELECT 'part' || p_partkey AS x FROM part")
def instances_of_superclass(spark, sf):
    return kg.Graph(spark).tell(facts(spark, sf)).match(P("?x", "type", "Part"))


@query("SELECT o_orderkey AS o, o_custkey AS c, c_nationkey * 10 AS o10 FROM orders JOIN customer ON o_custkey = c_custkey")
def user_reasoner(spark, sf):
    """A predicate answered by a function that returns a DataFrame joins like any other."""
    g = graph(spark, sf)
    g.reasoner("tenfold", lambda pattern: read(spark, sf, "customer").select(F.col("c_custkey").alias("s"), (F.col("c_nationkey") * 10).alias("o")))
    return g.ask(P("?o", "placedBy", "?c"), P("?c", "tenfold", "?o10"))


# --- transitive relations

_GEO = """geo AS (SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'world' FROM region)"""


@query(f"""WITH RECURSIVE {_GEO}, up(src, dst, depth) AS (SELECT src, dst, 1 FROM geo UNION ALL SELECT up.src, geo.dst, depth + 1 FROM up JOIN geo ON up.dst = geo.src) SELECT src, dst, depth FROM up""")
def transitive(spark, sf):
    return reach(geography(spark, sf))


@query(f"""WITH RECURSIVE {_GEO}, up(src, dst, depth) AS (SELECT DISTINCT src, src, 0 FROM geo WHERE src LIKE 's:%' UNION ALL SELECT up.src, geo.dst, depth + 1 FROM up JOIN geo ON up.dst = geo.src) SELECT src, dst, depth FROM up""")
def transitive_reflexive_from(spark, sf):
    start = geography(spark, sf).where("src LIKE 's:%'").select("src")
    return reach(geography(spark, sf), reflexive=True, start=start)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
up(src, dst) AS (SELECT src, dst FROM e UNION SELECT up.src, e.dst FROM up JOIN e ON up.dst = e.src) SELECT src, dst FROM up""")
def transitive_with_cycles(spark, sf):
    """All nations that goods of a nation can come to, over any number of sales by suppliers to customers. Nations are few at any
    size of the tables, so that all pairs fit."""
    supplier = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    customer = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    orders = read(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst")
    sold = read(spark, sf, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "src").distinct()
    return reach(sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst")).select("src", "dst")


_TRADE = """trade AS (SELECT DISTINCT 'p:' || l_partkey AS src, 's:' || l_suppkey AS dst FROM lineitem UNION SELECT 's:' || l_suppkey, 'p:' || l_partkey FROM lineitem)"""


@query(f"""WITH RECURSIVE {_TRADE}, start AS (SELECT 's:' || min(l_suppkey) AS src FROM lineitem), up(src, dst) AS (SELECT src, dst FROM trade WHERE src = (SELECT src FROM start) UNION SELECT up.src, trade.dst FROM up JOIN trade ON up.dst = trade.src) SELECT src, dst FROM up""")
def reach_in_cycles(spark, sf):
    """All parts and suppliers that the first supplier is linked to by any line, both ways, so that every edge is in a cycle.

    The closure of all pairs is as large as the square of a component; a start's is as large as the component.
    """
    line = read(spark, sf, "lineitem")
    part, supplier = F.concat(F.lit("p:"), F.col("l_partkey")), F.concat(F.lit("s:"), F.col("l_suppkey"))
    edges = line.select(part.alias("src"), supplier.alias("dst")).unionByName(line.select(supplier.alias("src"), part.alias("dst")))
    start = line.agg(F.concat(F.lit("s:"), F.min("l_suppkey")).alias("src"))
    return reach(edges, start=start).select("src", "dst")
