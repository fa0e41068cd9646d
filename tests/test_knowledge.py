"""Formulas, unbound variables, rules, time, relations and frames on small tables whose answers are counted by hand."""

import pytest
from pyspark.sql import functions as F

from lorekeep.formula import Modal, answers, explain, fact, holds, substitute
from lorekeep.graph import Graph
from lorekeep.operators import bindings, intervals, owl, qualitative
from lorekeep.operators.taxonomy import closure, reach
from lorekeep.plans import knowledge, registry  # noqa: F401  the module registers its queries
from lorekeep.relations import Fluent, Relation
from lorekeep.rules import Rule, backward, fire, restructure, solve
from lorekeep.terms import Frame, Pattern, always, at, believe, gt, know
from tests import oracle

P = Pattern
ROWS = [("tom", "brother", "ann"), ("ann", "parent", "bo"), ("tom", "age", "41"), ("bo", "age", "7"), ("tom", "type", "Man"), ("ann", "type", "Woman"), ("bo", "type", "Child"), ("Man", "subClassOf", "Adult"), ("Woman", "subClassOf", "Adult"), ("Adult", "subClassOf", "Human"), ("Child", "subClassOf", "Human")]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(ROWS, "s string, p string, o string")


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_formulas(spark, facts):
    g = Graph(spark).tell(facts)
    assert rows(answers(g, (fact("?x", "brother", "?y") | fact("?x", "parent", "?y")) & fact("?x", "type", "?c"))) == [("Man", "tom", "ann"), ("Woman", "ann", "bo")]
    assert rows(answers(g, fact("?x", "type", "Adult") & ~fact("?x", "parent", "?y"))) == [("tom",)]
    assert [holds(g, f) for f in (fact("tom", "brother", "ann"), fact("tom", "brother", "bo"), fact("tom", "enemy", "?x"), ~fact("tom", "brother", "bo"), fact("tom", "enemy", "?x") | fact("bo", "age", "7"))] == ["yes", "no", "unknown", "yes", "yes"]
    assert explain(g, fact("?x", "age", gt(20, "?a"))).first().because == ["age(tom, 41.0)"]
    assert rows(answers(g, substitute(fact("?x", "brother", "?y"), {"x": "tom"}))) == [("ann",)]
    doubt = g.tell(spark.createDataFrame([("tom", "likes", "bo", True, 0.7, "ann")], "s string, p string, o string, uncertain boolean, confidence double, agent string"))
    assert rows(answers(doubt, Modal("B", fact("tom", "likes", "?x") & ~fact("?x", "likes", "?y"), agent="ann", confidence=0.5))) == [("bo",)]
    assert answers(doubt, Modal("K", fact("tom", "likes", "?x"), agent="ann")).count() == 0
    with pytest.raises(ValueError, match="mind"):
        answers(doubt, Modal("K", Modal("B", fact("tom", "likes", "?x"), agent="bo"), agent="ann"))
    with pytest.raises(ValueError):
        know(Frame(agent="a"), "b")


def test_unbound_variables_match_anything(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([("x", 9)], "v string, w int")
    assert rows(bindings.negation(a, b)) == [(3, "z")] and rows(bindings.semi(a, b).select("k")) == [(1,), (2,)]
    assert rows(bindings.join(a, b, ("v",))) == [(1, "x", 9), (2, "x", 9)]
    assert rows(bindings.join(a, b, ("v",), "left").select("k")) == [(1,), (2,), (3,)]
    assert bindings.negation(a, b.limit(0)).count() == 3 and bindings.semi(a, b.limit(0)).count() == 0
    wild = b.unionByName(spark.createDataFrame([(None, 1)], "v string, w int"))
    assert bindings.negation(a, wild).count() == 0
    assert "CartesianProduct" not in bindings.join(a, b, ("v",)).where("k > 5 AND v IS NOT NULL")._jdf.queryExecution().toString().split("Physical Plan")[0]


def test_origins_of_answers_merge(spark):
    kinds = "s string, p string, o string, graph string, agent string"
    g = Graph(spark).tell(spark.createDataFrame([("a", "p", "b", "g1", None), ("b", "q", "c", "g2", None), ("b", "r", "d", "g1", None)], kinds))
    assert [r["_graph"] for r in g.ask(P("?x", "p", "?y"), P("?y", "q", "?z"), with_origin=True).collect()] == [None]
    assert [r["_graph"] for r in g.ask(P("?x", "p", "?y"), P("?y", "r", "?z"), with_origin=True).collect()] == ["g1"]


def test_property_metadata(spark, facts):
    g = Graph(spark).tell(facts).declare(spark.createDataFrame([("child", "inverseOf", "parent"), ("brother", "type", "SymmetricProperty")], "s string, p string, o string"))
    assert rows(g.match(P("bo", "child", "?x"))) == [("ann",)] and rows(g.match(P("ann", "brother", "?x"))) == [("tom",)]
    assert rows(g.match(P("Man", "subClassOf", "?x"))) == [("Adult",), ("Human",)] and g.holds(P("bo", "child", "ann"))
    g.flags("before", transitive=True)
    g = g.tell(spark.createDataFrame([("a", "before", "b"), ("b", "before", "c"), ("c", "before", "a")], "s string, p string, o string"))
    assert len(rows(g.match(P("?x", "before", "?y")))) == 9 and rows(g.match(P("?x", "before", "?x"))) == [("a",), ("b",), ("c",)]


def test_rules(spark, facts):
    assert solve(facts, ("?x", "brother", "?x")).count() == 0
    uncle = Rule([("?x", "brother", "?y"), ("?y", "parent", "?z")], [("?x", "uncleOf", "?z")])
    lonely = Rule([("?x", "type", "Man")], [("?x", "is", "lonely")], absent=[("?x", "uncleOf", "?z")])
    assert rows(fire(facts, [lonely, uncle])) == [("bo", "uncleOf", "tom")]
    assert rows(backward(facts, [lonely, uncle], ("?x", "uncleOf", "?z"))) == [("tom", "bo")]
    with pytest.raises(ValueError, match="absence"):
        fire(facts, [Rule([("?x", "type", "Man")], [("?x", "p", "1")], absent=[("?x", "p", "?y")])])
    with pytest.raises(RuntimeError, match="no end"):
        fire(facts, [Rule([("?x", "age", "?n")], [("?x", "age", "?m")], where=lambda d: d.withColumn("m", F.concat("n", F.lit("1"))))], most_rounds=4)
    whole = restructure(facts, [Rule([("?x", "parent", "?y")], [("?y", "childOf", "?x")])])
    assert whole.where("p = 'parent'").count() == 0 and whole.where("p = 'childOf' AND s = 'bo'").count() == 1 and whole.count() == len(ROWS)
    new = facts.where("p = 'brother'")
    assert rows(fire(facts, [uncle], new=new)) == [("bo", "uncleOf", "tom")] and fire(facts, [uncle], new=facts.where("p = 'age'")).count() == 0


def test_class_expressions(spark, facts):
    assert rows(owl.expression(facts, ("and", "Adult", ("not", ("some", "parent", "Child"))))) == [("tom",)]
    assert rows(owl.expression(facts, ("only", "parent", "Man"))) == [("bo",), ("tom",)] and rows(owl.expression(facts, ("max", "parent", 0))) == [("bo",), ("tom",)]
    assert rows(owl.expression(facts, ("exactly", "parent", 1, "Child"))) == [("ann",)]
    told = spark.createDataFrame([("C", "unionOf", "l1"), ("l1", "first", "Man"), ("l1", "rest", "l2"), ("l2", "first", "r"), ("l2", "rest", "nil"), ("r", "onProperty", "parent"), ("r", "minCardinality", "1")], "s string, p string, o string")
    assert owl.read_expression(told, "C") == ("or", "Man", ("min", "parent", 1))


def test_overlaps_with_open_and_long_intervals(spark):
    data = [(1, 0.0, 5.0), (2, 5.0, 9.0), (3, None, 1.0), (4, 8.0, None), (5, 2.0, 9000.0), (6, None, None), (7, 2.0, 2.0)]
    a = spark.createDataFrame([("k", *r) for r in data], "g string, i int, begin double, end double")
    got = intervals.overlap_join(a, a.withColumnRenamed("i", "j"), ["g"], 1.0)
    inf = float("inf")
    spans = {i: (-inf if b is None else b, inf if e is None else e) for i, b, e in data}
    want = sorted((i, j) for i in spans for j in spans if spans[i][0] <= spans[j][1] and spans[j][0] <= spans[i][1])
    assert sorted((r.i, r.j) for r in got.collect()) == want
    before = sum(spans[i][1] < spans[j][0] for i in spans for j in spans)
    assert intervals.count_before(a.where("end IS NOT NULL"), a.where("begin IS NOT NULL"), ["g"]).first().n == before


@pytest.mark.parametrize("most_slots", [64, 4])
def test_overlaps_are_made_by_one_deal_unless_rows_are_wide(spark, most_slots):
    inf = float("inf")
    data = [(i, i % 2, 8.0 * i, 8.0 * i + i % 12) for i in range(60)] + [(60, 0, 0.0, 480.0), (61, 0, 300.0, None), (62, 1, -inf, 40.0), (63, 1, None, inf), (64, 0, 50.0, 20.0)]
    a = spark.createDataFrame(data, "i int, g int, begin double, end double")
    got = intervals.overlap_join(a, a.withColumnRenamed("i", "j"), ["g"], 1.0, most_slots)
    spans = {i: (g, -inf if b is None else b, inf if e is None else e) for i, g, b, e in data}
    want = sorted((i, j) for i, x in spans.items() for j, y in spans.items() if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert sorted((r.i, r.j) for r in got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == (1 if most_slots == 64 else 3)


def test_intervals_of_answers(spark):
    g = Graph(spark).tell(spark.createDataFrame([("a", "in", "x", 0.0, 10.0), ("b", "in", "x", 4.0, None)], "s string, p string, o string, begin double, end double"))
    assert rows(g.match(P("?s", "in", "x", at(2.0)))) == [("a",)] and rows(g.match(P("?s", "in", "x", always(begin=5.0)))) == [("b",)]
    held = g.match(P("?s", "in", "x"), with_frame=True)
    assert rows(intervals.bind_during(held, "b", "e").select("s", "b", "e")) == [(0.0, 10.0, "a"), (4.0, float("inf"), "b")]
    events = spark.createDataFrame([("e1", 5.0, 6.0), ("e2", 20.0, 30.0)], "event string, begin double, end double")
    assert rows(intervals.during_event(held, events, "event").select("s", "event")) == [("e1", "a"), ("e1", "b"), ("e2", "b")]
    assert rows(intervals.occurs(events, 5.5).select("event")) == [("e1",)]


def test_ties_are_decided_by_values(spark):
    samples = spark.createDataFrame([("k", 1.0, "a"), ("k", 1.0, "b"), ("k", 0.0, "z")], "key string, t double, v string")
    assert rows(intervals.value_at(samples, ["key"], ["v"], "t", F.lit(2.0)).select("v")) == [("b",)]
    left = spark.createDataFrame([("k", 1.0, 5)], "key string, t double, id int")
    assert rows(intervals.as_of_join(left, samples, ["key"], "t", "t", ["v"]).select("v")) == [("b",)]


def test_fluents_and_relations(spark):
    def told(value, time):
        return spark.createDataFrame([("k", value, time)], "key string, value double, time double")

    f = Fluent.declare(spark, "key string", "value double").tell(told(4.0, 1.0)).tell(told(6.0, 2.0))
    assert rows(f.at(F.lit(3.0)).select("value")) == [(6.0,)] and rows(f.forget(told(6.0, 2.0)).at(F.lit(3.0)).select("value")) == [(4.0,)]
    assert f.end(told(0.0, 5.0)).at(F.lit(6.0)).count() == 0 and rows(f.within(F.lit(1.5), F.lit(9.0)).select("value")) == [(4.0,), (6.0,)]
    r = Relation.declare(spark, "name string, term struct<functor:string,args:array<double>>").tell(spark.createDataFrame([("o1", ("sphere", [1.0])), ("o2", ("box", [1.0, 2.0]))], "name string, term struct<functor:string,args:array<double>>"))
    assert rows(r.ask("o1", "?t").select("t.functor")) == [("sphere",)] and rows(r.forget("o1", "?t").ask("?n", "?t").select("n")) == [("o2",)]


def test_relations_that_follow(spark):
    told = spark.createDataFrame([("a", "meets", "b"), ("b", "starts", "c"), ("c", "before", "d")], "a string, relation string, b string")
    pairs = spark.createDataFrame([("a", "c"), ("a", "d"), ("b", "d"), ("d", "a"), ("b", "c")], "a string, b string")
    assert {(r.a, r.b, r.relation) for r in qualitative.infer(told, pairs).collect()} == {("a", "c", "meets"), ("a", "d", "before"), ("b", "d", "before"), ("d", "a", "after"), ("b", "c", "starts"), ("b", "c", "during")}
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0)], "src int, dst int")
    assert rows(closure(chain)) == rows(reach(chain).select("src", "dst"))
    assert believe(Frame(agent="a"), "a", 0.5).confidence == 0.5


def test_fluents_of_events_within_a_second(spark, tmp_path):
    """The last event decides, not the greatest value of its second; a sample without a value is taken back too."""
    duckdb = pytest.importorskip("duckdb")
    data = [(0, "00:00:01.2", 1, "view", 9.0), (1, "00:00:01.7", 1, "view", 2.0), (2, "00:00:01.1", 2, "error", 1.0), (3, "00:00:01.8", 2, "view", 4.0), (4, "00:00:01.0", 3, "view", 5.0), (5, "00:00:02.0", 3, "click", None)]
    frame = spark.createDataFrame(data, "event_id long, t string, user_id long, event_type string, value double")
    frame.withColumn("ts", F.to_timestamp_ntz(F.concat(F.lit("2024-01-01 "), "t"))).drop("t").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = registry.QUERIES["fluent_assert"](spark, str(tmp_path))
    assert rows(got) == [(1, 2.0), (2, 4.0), (3, 5.0)]
    oracle.compare(got, con, registry.ORACLES["fluent_assert"])
