"""Formulas, unbound variables, fluents, relations, property metadata, rules, qualitative time and frames over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorekeep import graph as kg
from lorekeep.formula import Modal, answers, explain, fact
from lorekeep.functions import transforms as tf
from lorekeep.operators import bindings, intervals, owl, pose_tree, qualitative
from lorekeep.plans.patterns import _STORE, _store
from lorekeep.plans.reasoning import _SPANS, _spans
from lorekeep.plans.registry import query
from lorekeep.plans.tables import facts, graph, read, seconds
from lorekeep.relations import Fluent, Relation, annotations
from lorekeep.rules import Rule, backward, fire, restructure
from lorekeep.shared import materialize, shared_dir
from lorekeep.sources import rdf
from lorekeep.terms import Pattern, gt, lt, prefix, sometimes

P = Pattern

# --- formulas


@query("""SELECT DISTINCT c_custkey AS c, c_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_acctbal > 8000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000))
AND n_regionkey <> 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def formula_nested(spark, sf):
    """(rich or with a dear order) and in a nation, not of region 1, and without a pending order."""
    dear = fact("?o", "placedBy", "?c") & fact("?o", "totalPrice", gt(450000))
    pending = fact("?q", "placedBy", "?c") & fact("?q", "status", "P")
    found = answers(graph(spark, sf), (fact("?c", "balance", gt(8000)) | dear) & fact("?c", "hasNation", "?n") & ~fact("?n", "inRegion", 1) & ~pending)
    return found.select("c", "n").distinct()


@query("""SELECT c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 0""")
def formula_implication(spark, sf):
    """A customer of the segment BUILDING must have a positive balance; all that keep the rule."""
    g = graph(spark, sf)
    every = g.match(P("?c", "customerName", "?_")).select("c")
    return answers(g, fact("?c", "segment", "BUILDING") >> fact("?c", "balance", gt(0)), given=every).select("c").distinct()


@query("""SELECT a.l_orderkey AS o, a.l_partkey AS p, b.l_suppkey AS s FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND 1 - a.l_discount * 5 >= 0.8 AND 1 - b.l_discount * 5 >= 0.8""")
def modal_formula(spark, sf):
    """B[returns, 0.8] over a conjunction."""
    return answers(graph(spark, sf), Modal("B", fact("?o", "hasPart", "?p") & fact("?o", "suppliedBy", "?s"), agent="returns", confidence=0.8))


@query("""SELECT c_custkey AS c, c_nationkey AS n, array_to_string(['balance(' || c_custkey || ', 9000)', 'hasNation(' || c_custkey || ', ' || c_nationkey || ')'], ' & ') AS because FROM customer WHERE c_acctbal > 9000""")
def explained_answers(spark, sf):
    found = explain(graph(spark, sf), fact("?c", "balance", gt(9000)) & fact("?c", "hasNation", "?n"))
    return found.withColumn("because", F.array_join("because", " & "))


# --- variables that may be unbound

_MAYBE = """l AS (SELECT c_custkey AS c, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS n FROM customer), r AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 1)"""


def _maybe(spark, sf):
    g = graph(spark, sf)
    left = g.ask(P("?c", "hasNation", "?n"), P("?c", "balance", "?b")).withColumn("n", F.when(F.col("b") > 0, F.col("n"))).drop("b")
    return left, g.match(P("?n", "inRegion", 1))


@query(f"WITH {_MAYBE} SELECT c, n FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE l.n IS NULL OR l.n = r.n)")
def negation_unbound(spark, sf):
    return bindings.negation(*_maybe(spark, sf))


@query(f"WITH {_MAYBE} SELECT c, n FROM l WHERE EXISTS (SELECT 1 FROM r WHERE l.n IS NULL OR l.n = r.n)")
def semi_unbound(spark, sf):
    return bindings.semi(*_maybe(spark, sf))


# --- time


@query(f"""WITH {_STORE} SELECT x.s, x.o, y.o AS o2, greatest(x.b, y.b) AS t_begin, least(x.e, y.e) AS t_end FROM store x JOIN store y ON x.s = y.s AND greatest(x.b, y.b) < least(x.e, y.e)
WHERE x.graph = '1' AND y.graph = '5' AND NOT x.uncertain AND NOT y.uncertain""")
def timed_conjunction(spark, sf):
    """Two timed facts of one customer hold together in the time that both have."""
    t = _store(spark, sf).triples
    g = kg.Graph(spark).tell(t.where("graph = '1'").withColumn("p", F.lit("urgent"))).tell(t.where("graph = '5'").withColumn("p", F.lit("low")))
    found = g.ask(P("?s", "urgent", "?o"), P("?s", "low", "?o2"), with_frame=True)
    return found.select("s", "o", "o2", F.col("_begin").alias("t_begin"), F.col("_end").alias("t_end"))


@query(f"""WITH {_SPANS}, o AS (SELECT k, c, b, CASE WHEN k % 50 <> 0 THEN e END AS e FROM spans) SELECT x.k AS k, y.k AS k2, greatest(x.b, y.b) AS t_begin, CASE WHEN x.e IS NULL THEN y.e WHEN y.e IS NULL THEN x.e ELSE least(x.e, y.e) END AS t_end
FROM o x JOIN o y ON x.c = y.c AND x.k < y.k AND (y.e IS NULL OR x.b <= y.e) AND (x.e IS NULL OR y.b <= x.e)""")
def overlap_open(spark, sf):
    """Orders of a customer that run at one time, where every fiftieth never ends."""
    a = materialize(_spans(spark, sf).withColumn("end", F.when(F.col("k") % 50 != 0, F.col("end"))), "spans")
    pairs = intervals.overlap_join(a.withColumnRenamed("k", "k1"), a.withColumnRenamed("k", "k2"), ["c"], 30 * 86400.0).where("k1 < k2")
    return pairs.select(F.col("k1").alias("k"), "k2", F.col("begin").alias("t_begin"), F.col("end").alias("t_end"))


@query(f"""WITH {_STORE}, m AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY s, o ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM store),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY s, o ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT s, o, CASE WHEN min(graph) = max(graph) THEN min(graph) END AS graph, bool_or(uncertain) AS uncertain, min(b) AS t_begin, max(e) AS t_end FROM r GROUP BY s, o, run""")
def merge_frames(spark, sf):
    """Overlapping facts merge whatever their flags."""
    merged = kg.Graph(spark).merge_frames(_store(spark, sf).triples)
    return merged.triples.select("s", "o", "graph", "uncertain", F.col("begin").alias("t_begin"), F.col("end").alias("t_end"))


@query(f"WITH {_STORE}, ev AS (SELECT n_nationkey AS event, 10000.0 + 30 * n_nationkey AS b, 10010.0 + 30 * n_nationkey AS e FROM nation) SELECT s, o, event FROM store JOIN ev ON store.b <= ev.b AND store.e >= ev.e WHERE NOT uncertain")
def during_event(spark, sf):
    """Facts that hold throughout an event; ten days for each nation's number stand for events."""
    n = F.col("n_nationkey").cast("double")
    events = read(spark, sf, "nation").select(F.col("n_nationkey").alias("event"), (10000 + 30 * n).alias("begin"), (10010 + 30 * n).alias("end"))
    found = _store(spark, sf).match(P("?s", "state", "?o"), with_frame=True)
    return intervals.during_event(found, events, "event").select("s", "o", "event")


@query(f"WITH {_STORE} SELECT s, o, b AS since, e AS until FROM store WHERE NOT uncertain AND b <= 10500 AND e >= 10480")
def bound_intervals(spark, sf):
    """The times that a fact holds, as values of variables."""
    found = _store(spark, sf).match(P("?s", "state", "?o", sometimes(begin=10480.0, end=10500.0)), with_frame=True)
    return intervals.bind_during(found, "since", "until").select("s", "o", "since", "until")


@query(f"WITH {_SPANS} SELECT k, c FROM spans WHERE b <= 880000000 AND e >= 880000000")
def occurring_events(spark, sf):
    return intervals.occurs(_spans(spark, sf), 880000000.0).select("k", "c")


@query("""WITH RECURSIVE q AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), r AS (SELECT m, lead(m) OVER (ORDER BY m) AS nxt FROM q) SELECT 'm' || a.m AS a, 'm' || b.m AS b,
CASE WHEN a.nxt = b.m THEN 'meets' WHEN b.nxt = a.m THEN 'met_by' WHEN a.m < b.m THEN 'before' WHEN a.m > b.m THEN 'after' END AS relation FROM r a JOIN r b ON a.m <> b.m""")
def interval_paths(spark, sf):
    """Of months only "meets" the next is told; all other relations follow."""
    months = read(spark, sf, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).distinct()
    ranked = months.groupBy().agg(F.array_sort(F.collect_set("m")).alias("m")).select(F.posexplode("m").alias("i", "m"))
    told = ranked.alias("x").join(ranked.alias("y"), F.expr("x.i + 1 = y.i")).select(F.concat(F.lit("m"), "x.m").alias("a"), F.lit("meets").alias("relation"), F.concat(F.lit("m"), "y.m").alias("b"))
    names = months.select(F.concat(F.lit("m"), "m").alias("a"))
    return qualitative.infer(told, names.join(names.withColumnRenamed("a", "b"), F.expr("a <> b")))


# --- fluents, relations, annotations


@query("""WITH e AS (SELECT user_id, event_type, epoch(ts)::DOUBLE AS t, value FROM events), told AS (SELECT user_id, value, t FROM e WHERE event_type <> 'error' EXCEPT SELECT user_id, value, t FROM e WHERE event_type = 'click'),
ended AS (SELECT user_id, t FROM e WHERE event_type = 'error'), s AS (SELECT user_id, value, t, false AS gone FROM told UNION SELECT user_id, NULL, t, true FROM ended)
SELECT user_id, value FROM (SELECT * FROM s WHERE t <= 1705276800 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, gone DESC, value DESC) = 1) WHERE NOT gone""")
def fluent_assert(spark, sf):
    """Events set a user's value, clicks are taken back, and an error ends it."""
    e = read(spark, sf, "events").select("user_id", "value", seconds(F.col("ts")).alias("time"), "event_type")
    fluent = Fluent.declare(spark, "user_id bigint", "value double").tell(e.where("event_type <> 'error'")).forget(e.where("event_type = 'click'")).end(e.where("event_type = 'error'"))
    return fluent.at(F.lit(1705276800.0))


@query("""SELECT 'part' || p_partkey AS s, 'made of ' || p_type AS t FROM part WHERE p_size > 25 AND p_type <> 'PROMO' AND starts_with(p_type, 'S')""")
def annotation_texts(spark, sf):
    part = read(spark, sf, "part").where("p_size > 25")
    notes = annotations(spark).tell(part.select(F.concat(F.lit("part"), "p_partkey").alias("s"), F.lit("comment").alias("p"), F.concat(F.lit("made of "), "p_type").alias("text")))
    return notes.forget("?s", "comment", "made of PROMO").ask("?s", "comment", prefix("made of S", "?t"))


@query("""SELECT p_partkey AS x, p_retailprice AS price FROM part WHERE p_size = 7 AND p_retailprice < 1500 AND p_brand <> 'Brand#1'""")
def relation_of_terms(spark, sf):
    """A relation of three columns, asked with constants, an operator and variables, after some rows were taken back."""
    held = Relation.declare(spark, "k bigint, size int, brand string, price double").tell(read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price")))
    return held.forget("?k", "?s", "Brand#1", "?p").ask("?x", 7, "?_b", lt(1500, "?price")).select("x", "price")


# --- properties


@query("SELECT n_nationkey::VARCHAR AS n, c_custkey::VARCHAR AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def inverse_property(spark, sf):
    """A predicate that only its inverse has facts of."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("s"), F.lit("livesIn").alias("p"), F.col("c_nationkey").cast("string").alias("o"))
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("s"), F.lit("region").alias("p"), F.col("n_regionkey").cast("string").alias("o"))
    g = kg.Graph(spark).tell(c.unionByName(n)).declare(spark.createDataFrame([("hasInhabitant", "inverseOf", "livesIn")], "s string, p string, o string"))
    return g.ask(P("?n", "hasInhabitant", "?c"), P("?n", "region", "2")).select("n", "c")


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT 's' || a AS x, 'p' || b AS y FROM t UNION ALL SELECT 'p' || b, 's' || a FROM t""")
def symmetric_property(spark, sf):
    line = read(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.lit("deals").alias("p"), F.concat(F.lit("p"), "l_partkey").alias("o")).distinct()
    return kg.Graph(spark).tell(line).flags("deals", symmetric=True).match(P("?x", "deals", "?y"))


@query("""SELECT DISTINCT p_brand AS x FROM part UNION SELECT DISTINCT 'T_' || p_type FROM part UNION SELECT 'Branded' UNION SELECT 'Typed'""")
def subclass_pattern(spark, sf):
    """Patterns of subClassOf answer by the closure."""
    return kg.Graph(spark).tell(facts(spark, sf)).match(P("?x", "subClassOf", "Part"))


@query("""SELECT DISTINCT 'T_' || p_type AS s, 'class' AS kind FROM part UNION SELECT DISTINCT p_brand, 'class' FROM part UNION SELECT 'contains', 'object_property' UNION SELECT 'size', 'data_property'""")
def term_kinds(spark, sf):
    return owl.kinds(_declared(spark, sf))


def _declared(spark, sf):
    """Facts with declarations: classes, two properties, their domains and ranges."""
    f = facts(spark, sf)
    classes = f.where("p = 'subClassOf' AND o IN ('Branded', 'Typed')").select("s", F.lit("type").alias("p"), F.lit("Class").alias("o")).distinct()
    rows = [("contains", "type", "ObjectProperty"), ("size", "type", "DatatypeProperty"), ("contains", "range", "Brand#1"), ("size", "domain", "Branded"), ("holds", "range", "Part"), ("contains", "subPropertyOf", "holds")]
    return f.unionByName(classes).unionByName(spark.createDataFrame(rows, "s string, p string, o string"))


@query("""SELECT 'contains' AS p, 'range' AS kind, unnest(['Brand#1', 'Part']) AS cls UNION ALL SELECT 'size', 'domain', 'Branded' UNION ALL SELECT 'holds', 'range', 'Part'""")
def domains_and_ranges(spark, sf):
    return owl.domains_and_ranges(_declared(spark, sf))


@query("""SELECT DISTINCT 'order' || l_orderkey AS s, 'contains' AS p, 'part' || p_partkey AS o, 'range' AS kind, 'Brand#1' AS cls FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#1'""")
def ill_typed_facts(spark, sf):
    return owl.ill_typed(_declared(spark, sf))


@query("""SELECT 'part' || p_partkey AS s FROM part WHERE p_brand = 'Brand#4' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)""")
def missing_values(spark, sf):
    """Individuals of a class without any value of a property."""
    line = read(spark, sf, "lineitem").where("l_quantity < 3").select(F.concat(F.lit("part"), "l_partkey").alias("s"), F.lit("soldIn").alias("p"), F.concat(F.lit("order"), "l_orderkey").alias("o"))
    return owl.missing(facts(spark, sf).unionByName(line), "Brand#4", "soldIn")


# --- class expressions and rules


@query("""SELECT DISTINCT 'order' || l_orderkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING bool_or(p_brand = 'Brand#2') AND (count(DISTINCT l_partkey) >= 4 OR bool_or(p_size = 9))""")
def swrl_class_expression(spark, sf):
    """contains some Brand#2, and at least four parts or one of size 9."""
    f = facts(spark, sf)
    nine = spark.createDataFrame([("Nine", "equivalentClass", "r"), ("r", "onProperty", "size"), ("r", "hasValue", "9")], "s string, p string, o string")
    f = f.unionByName(nine)
    parts = ("or", ("min", "contains", 4), ("some", "contains", owl.read_expression(f, "Nine")))
    return owl.expression(f, ("and", ("some", "contains", "Brand#2"), parts))


@query("""SELECT 'part' || p_partkey AS x FROM part WHERE p_size > 40 AND p_brand <> 'Brand#1'""")
def swrl_backward(spark, sf):
    """A question that rules answer, of which only those that lead to it fire; one asks that a fact be absent."""
    rules = [
        Rule([("?x", "size", gt(40))], [("?x", "type", "Big")]), Rule([("?x", "type", "Big")], [("?x", "is", "rare")], absent=[("?x", "type", "Brand#1")]),
        Rule([("?o", "contains", "?x")], [("?x", "in", "?o")]),
    ]
    return backward(facts(spark, sf), rules, ("?x", "is", "rare"))


@query("""WITH o AS (SELECT l_orderkey AS k, bool_or(p_size > 40) AS heavy, bool_or(p_size < 5) AS small FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT 'order' || k AS s, 'type' AS p, 'Heavy' AS o FROM o WHERE heavy UNION ALL SELECT 'order' || k, 'type', 'Light' FROM o WHERE small AND NOT heavy UNION ALL SELECT 'order' || k, 'ships', 'by_air' FROM o WHERE small AND NOT heavy""")
def rule_strata(spark, sf):
    """Light is what isn't Heavy, whichever rule stands first."""
    return fire(facts(spark, sf), [
        Rule([("?o", "type", "Light")], [("?o", "ships", "by_air")]),
        Rule([("?o", "contains", "?x"), ("?x", "size", lt(5))], [("?o", "type", "Light")], absent=[("?o", "type", "Heavy")]),
        Rule([("?o", "contains", "?x"), ("?x", "size", gt(40))], [("?o", "type", "Heavy")]),
    ])


@query("""SELECT 'part' || p_partkey AS s, 'described' AS p, p_brand || ' ' || p_size AS o FROM part WHERE p_brand LIKE 'Brand#_'""")
def restructured_facts(spark, sf):
    """Two facts of a part become one; what no rule takes stays."""
    f = facts(spark, sf).where("p = 'size' OR (p = 'type' AND o LIKE 'Brand#_')")
    whole = restructure(f, [Rule([("?x", "type", "?b"), ("?x", "size", "?n")], [("?x", "described", "?d")], where=lambda df: df.withColumn("d", F.concat_ws(" ", "b", "n")))])
    return whole.where("p = 'described'")


# --- files


@query("""SELECT 'http://x.org/n' || n_nationkey AS s, 'http://x.org/name' AS p, 'lit' AS o_kind, n_name || ' "' || n_regionkey || chr(92) || '"' AS o FROM nation UNION ALL
SELECT 'http://x.org/n' || n_nationkey, 'http://x.org/in', 'iri', 'http://x.org/r' || n_regionkey FROM nation""")
def ntriples_file(spark, sf):
    """Nations written as N-Triples, and read."""
    n = read(spark, sf, "nation")
    text = F.replace(F.replace(F.concat(F.col("n_name"), F.lit(' "'), "n_regionkey", F.lit('\\"')), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    name = F.concat(F.lit("<http://x.org/n"), "n_nationkey", F.lit('> <http://x.org/name> "'), text, F.lit('" .'))
    place = F.concat(F.lit("<http://x.org/n"), "n_nationkey", F.lit("> <http://x.org/in> <http://x.org/r"), "n_regionkey", F.lit("> ."))
    path = f"{shared_dir(spark)}/nations-{uuid.uuid4().hex}"
    n.select(F.explode(F.array(name, place)).alias("value")).write.text(path)
    return rdf.load(spark, path, "ntriples").select("s", "p", "o_kind", "o")


@query("""SELECT 'http://x.org/n' || n_nationkey AS s, n_name AS name, n_regionkey::DOUBLE AS region FROM nation""")
def turtle_file(spark, sf):
    """Nations written as Turtle, with a nested node for the region, and read."""
    n = read(spark, sf, "nation")
    rows = F.concat(F.lit("@prefix x: <http://x.org/> . x:n"), "n_nationkey", F.lit(" x:name '"), "n_name", F.lit("' ; x:in [ a x:Region ; x:number "), "n_regionkey", F.lit(" ] ."))
    path = f"{shared_dir(spark)}/nations-{uuid.uuid4().hex}"
    n.select(rows.alias("value")).coalesce(1).write.text(path)
    t = rdf.load(spark, f"{path}/*.txt", "turtle")
    g = kg.Graph(spark).tell(t.select("s", "p", "o", "o_num"))
    found = g.ask(P("?s", "http://x.org/name", "?name"), P("?s", "http://x.org/in", "?r"))
    return bindings.join(found, g.match(P("?r", "http://x.org/number", "?region"), numeric=True)).select("s", "name", "region")


# --- frames


@query("""SELECT 'c' || c_custkey AS child, round(c_acctbal + 10 * c_nationkey * cos(0.1 * n_regionkey) + 100 * n_regionkey, 4) AS x, round(10 * c_nationkey * sin(0.1 * n_regionkey) + 0.0, 4) AS y, 3 AS depth FROM (
SELECT c_custkey, c_nationkey, n_regionkey, 0.0 AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def pose_tree_join(spark, sf):
    """Customers in nations, nations in regions that are turned, regions in the world: poses in the world."""
    def frame(x, turn):
        return tf.pose(tf.vector(x, F.lit(0.0), F.lit(0.0)), tf.quaternion(F.lit(0.0), F.lit(0.0), F.sin(turn / 2), F.cos(turn / 2)))

    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    none, zero = F.lit(0.0), F.lit(0.0)
    samples = [
        c.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), frame(none, zero).alias("pose"), F.lit(1.0).alias("stamp")),
        n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), frame(F.col("n_nationkey") * 10.0, zero).alias("pose"), F.lit(1.0).alias("stamp")),
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"), frame(F.col("r_regionkey") * 100.0, F.col("r_regionkey") * 0.1).alias("pose"), F.lit(1.0).alias("stamp")),
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("nowhere").alias("parent"), frame(F.lit(7.0), zero).alias("pose"), F.lit(9.0).alias("stamp")),
    ]
    world = pose_tree.world_poses(pose_tree.poses_at(bindings.union(*samples), F.lit(5.0))).where("child LIKE 'c%'")
    at = F.col("pose.position")
    return world.select("child", F.round(at["x"], 4).alias("x"), F.round(at["y"] + 0.0, 4).alias("y"), "depth")
