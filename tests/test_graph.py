"""The expected answers of the knowledge-graph fixtures: family, frames, intervals, rules, control."""

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import builtins as fn
from lorekeep.graph import Graph, UnknownPredicate
from lorekeep.operators import bindings, control, intervals, owl
from lorekeep.operators.taxonomy import reach
from lorekeep.rules import Rule, fire
from lorekeep.terms import Frame, Pattern, always, believe, eq, geq, gt, know, leq, lt, sometimes

P = Pattern
FACTS = [("Fred", "hasSibling", "Ernest"), ("Ernest", "hasSibling", "Fred"), ("Fred", "hasAncestor", "Rex"), ("Lea", "hasAncestor", "Fred"), ("Lea", "hasParent", "Fred"), ("Rex", "isParentOf", "Ernest"), ("Rex", "isParentOf", "Fred"), ("Fred", "isParentOf", "Lea")]
FACTS += [("Ernest", "hasNumber", "123456"), ("Fred", "hasNumber", "+49123456"), ("Alex", "hasAge", "16"), ("Ernest", "hasAge", "18"), ("Fred", "hasAge", "34"), ("Lea", "hasAge", "12"), ("Fred", "hasCar", "true"), ("Ernest", "hasCar", "false")]
FACTS += [("RectangleSmall", "hasHeight", "6"), ("RectangleSmall", "hasWidth", "5"), ("RectangleBig", "hasHeight", "13"), ("RectangleBig", "hasWidth", "13")]
TYPES = [("Alex", "Woman"), ("Ernest", "Man"), ("Ernest", "Person"), ("Fred", "Man"), ("Fred", "Person"), ("Lea", "Man"), ("Lea", "Woman"), ("Lea", "Person"), ("Rex", "Man"), ("RectangleBig", "Rectangle"), ("RectangleSmall", "Rectangle")]


@pytest.fixture(scope="module")
def family(spark):
    rows = [(s, p, o) for s, p, o in FACTS] + [(s, "type", c) for s, c in TYPES] + [(c, "subClassOf", "TestThing") for c in ("Woman", "Man", "Person", "Rectangle")]
    return Graph(spark).tell(spark.createDataFrame(rows, "s string, p string, o string"))


def answers(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_formula_answers(family):
    assert answers(family.match(P("Fred", "hasSibling", "?x"))) == [("Ernest",)]
    assert answers(family.match(P("Lea", "hasSibling", "?x"))) == []
    assert answers(family.ask(P("Fred", "hasSibling", "?x"), P("?x", "hasNumber", "?n"))) == [("123456", "Ernest")]
    either = bindings.union(family.match(P("Fred", "hasSibling", "?x")), family.match(P("Fred", "hasAncestor", "?x")))
    assert answers(either) == [("Ernest",), ("Rex",)]
    assert answers(bindings.join(either, family.match(P("?x", "hasSibling", "?y")))) == [("Ernest", "Fred")]
    assert answers(bindings.negation(family.match(P("Fred", "hasAncestor", "?x")), family.match(P("?x", "hasSibling", "?y")))) == [("Rex",)]
    assert answers(family.match(P("Fred", "hasSibling", "?x", know()))) == answers(family.match(P("Fred", "hasSibling", "?x", believe()))) == [("Ernest",)]
    assert family.ask_one(P("Fred", "hasSibling", "?x")) == {"x": "Ernest"} and list(family.ask_iter(P("Lea", "hasParent", "?x"))) == [{"x": "Fred"}]
    with pytest.raises(UnknownPredicate):
        family.holds(P("Fred", "nothing", "?x"))
    assert family.holds(P("Fred", "hasSibling", "Ernest")) and not family.holds(P("Fred", "hasSibling", "Lea"))


def test_object_operators(family):
    for op, held in ((eq(6), True), (leq(9), True), (lt(7), True), (geq(5), True), (gt(3.5), True), (lt(3), False)):
        assert family.holds(P("RectangleSmall", "hasHeight", op)) == held
    assert answers(family.match(P("?x", "hasAge", gt(17, "?a")))) == [(18.0, "Ernest"), (34.0, "Fred")]
    assert answers(family.match(P("?x", "hasSibling", "?x"))) == []


def test_reasoner_and_idb(spark, family):
    family.reasoner("p", lambda _: spark.createDataFrame([("Ernest", "x")], "s string, o string")).reasoner("q", lambda _: spark.createDataFrame([("x", "y")], "s string, o string"))
    assert answers(family.ask(P("Fred", "hasSibling", "?x"), P("?x", "p", "?y"))) == [("Ernest", "x")]
    assert answers(family.ask(P("?x", "p", "?y"), P("?y", "q", "?z"))) == [("Ernest", "x", "y")]


def test_transitive(family):
    edges = family.triples.where("p = 'isParentOf'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    assert sorted(r.src for r in reach(edges).where("dst = 'Lea'").collect()) == ["Fred", "Rex"]
    assert sorted(r.dst for r in reach(edges, reflexive=True).where("src = 'Rex'").collect()) == ["Ernest", "Fred", "Lea", "Rex"]
    assert answers(family.match(P("?x", "type", "TestThing"))) == [(x,) for x in sorted({s for s, _ in TYPES})]


def test_frames(spark):
    def told(**frame):
        kinds = {"s": "string", "p": "string", "o": "string", "agent": "string", "uncertain": "boolean", "confidence": "double", "begin": "double", "end": "double"}
        row = {"s": "x", "p": "hasName", "o": "X"} | frame
        return Graph(spark).tell(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row)))

    def n(g, frame):
        return g.match(P("x", "hasName", "?n", frame)).count()

    g = told()
    assert n(g, know()) == n(g, believe()) == 1
    g = told(agent="Lea")
    assert (n(g, Frame(agent="Lea")), n(g, Frame(agent="Fred")), n(g, Frame())) == (1, 0, 0)
    g = told(uncertain=True)
    assert (n(g, believe()), n(g, know())) == (1, 0)
    g = told(uncertain=True, confidence=0.5)
    assert [n(g, believe(confidence=c)) for c in (0.5, 0.0, 0.9)] == [1, 1, 0]
    g = told(begin=5.0, end=10.0)
    assert (n(g, always(begin=5.0, end=10.0)), n(g, always(begin=5.0, end=20.0)), n(g, sometimes(begin=5.0, end=20.0))) == (1, 0, 1)
    g = g.merge_tell(spark.createDataFrame([("x", "hasName", "X", 10.0, 20.0)], "s string, p string, o string, begin double, end double"))
    assert [n(g, f) for f in (always(begin=10.0, end=20.0), always(begin=5.0, end=20.0), always(begin=0.0, end=20.0), sometimes(begin=0.0, end=20.0))] == [1, 1, 0, 1]


def test_intervals(spark):
    spans = {"Long": (1, 10), "Short1": (1, 2), "Short2": (2, 4), "Short3": (8, 10), "Short4": (9, 11)}

    def held(relation, a, b):
        row = spark.range(1).select(intervals.allen(relation, *(F.lit(x) for x in (*spans[a], *spans[b]))).alias("x"))
        return row.first().x

    assert all(held("during", s, "Long") for s in ("Short1", "Short2", "Short3")) and not held("during", "Short4", "Long")
    assert held("starts", "Short1", "Long") and held("finishes", "Short3", "Long") and held("meets", "Short1", "Short2") and not held("meets", "Short2", "Short3")
    assert held("overlaps", "Long", "Short4") and held("before", "Short2", "Short3") and held("before", "Short1", "Short3")


def test_fluents(spark):
    samples = spark.createDataFrame([("f", 1, 4.0), ("f", 5, 6.0)], "k string, t int, v double")
    now = intervals.value_at(samples, ["k"], ["v"], "t", F.lit(9))
    assert [r.v for r in now.collect()] == [6.0] and now.where("v = 4.0").count() == 0
    assert [r.v for r in intervals.value_at(samples.where("v <> 6.0"), ["k"], ["v"], "t", F.lit(9)).collect()] == [4.0]
    fact = spark.createDataFrame([(10.0, 34.0)], "b double, e double")
    assert [fact.where(intervals.during(F.col("b"), F.col("e"), *w)).count() for w in ((10.0, 34.0), (14.0, 24.0), (5.0, 20.0), (34.0, 44.0))] == [1, 1, 0, 0]


def test_rules(spark, family):
    facts = family.triples.select("s", "p", "o")
    rules = [
        Rule([("?x", "type", "Woman")], [("?x", "type", "Person")]), Rule([("?x", "type", "Man"), ("?x", "type", "Woman")], [("?x", "type", "Hermaphrodite")]), Rule([("?x", "type", "Person"), ("?x", "hasCar", "true")], [("?x", "type", "Driver")]),
        Rule([("?x", "hasNumber", "?n")], [("?x", "hasInternationalNumber", "?n")], where=lambda df: df.where(F.col("n").startswith("+"))), Rule([("?x", "hasSibling", "?y"), ("?y", "type", "Man")], [("?x", "hasBrother", "?y")]),
        Rule([("?r", "hasHeight", "?h"), ("?r", "hasWidth", "?w")], [("?r", "hasArea", "?a")], where=lambda df: df.withColumn("a", (F.col("h").cast("double") * F.col("w").cast("double")).cast("int"))),
        Rule([("?r", "hasArea", gt(100))], [("?r", "type", "BigRectangle")]), Rule([("?x", "hasAge", gt(17))], [("?x", "type", "Adult")]), Rule([("?x", "hasParent", "?y"), ("?y", "hasBrother", "?z")], [("?x", "hasUncle", "?z")]),
    ]
    new = {(r.s, r.p, r.o) for r in fire(facts, rules).collect()}
    assert {("Alex", "type", "Person"), ("Lea", "type", "Hermaphrodite"), ("Fred", "type", "Driver"), ("Fred", "hasInternationalNumber", "+49123456"), ("Fred", "hasBrother", "Ernest"), ("RectangleBig", "hasArea", "169"), ("RectangleBig", "type", "BigRectangle"), ("Ernest", "type", "Adult"), ("Lea", "hasUncle", "Ernest")} <= new
    assert not {("Ernest", "type", "Driver"), ("Fred", "type", "Hermaphrodite"), ("RectangleSmall", "type", "BigRectangle"), ("Lea", "type", "Adult")} & new


def test_control_goals(spark):
    one = spark.createDataFrame([(4.5,), (5.5,)], "num double")
    num, both = F.col("num"), control.disj(control.let("x", F.col("num") + 5), control.let("x", F.col("num") * 2), branch="b")
    lists = {r.num: r.xs for r in control.findall(both, F.col("x"), "xs", ["num"], ["b"])(one).collect()}
    assert lists == {4.5: [9.5, 9.0], 5.5: [10.5, 11.0]}
    first = control.first_branch(control.let("x", num + 5), control.let("x", num * 2), key=["num"], order=["num"])
    assert {r.num: r.x for r in first(one).collect()} == {4.5: 9.5, 5.5: 10.5}
    choice = control.if_then_else(control.where(num > 5), control.let("x", num * 2), control.let("x", num + 2), ["num"], ["num"])
    assert {r.num: r.x for r in choice(one).collect()} == {4.5: 6.5, 5.5: 11.0}
    empty = control.findall(control.conj(both, control.where(F.col("x") > 10.6)), F.col("x"), "xs", ["num"], ["b"])
    assert {r.num: r.xs for r in empty(one).collect()} == {4.5: [], 5.5: [11.0]}
    assert control.between(F.lit(5), F.lit(1), "i")(one).count() == 0 and control.fail(one).count() == 0


def test_scalar_edges(spark):
    row = spark.range(1).select(
        fn.divide(F.lit(1.0), F.lit(0.0)).alias("a"), fn.round_half_even(F.lit(2.5)).alias("b"), fn.modulo(F.lit(-7), F.lit(3)).alias("c"), fn.nth0(F.array(F.lit(1)), F.lit(4)).alias("d"),
        fn.truncate(F.lit(-1.5)).alias("e"), fn.index_of(F.array(F.lit("a")), F.lit("b")).alias("f"), fn.atom_number(F.lit("x")).alias("g"), fn.literal_less(F.lit("9"), F.lit("10")).alias("h"),
    ).first()
    assert tuple(row) == (None, 2.0, -1, None, -1, None, None, True)


def test_owl_lists_and_cycles(spark):
    cells = [("l1", "first", "a"), ("l1", "rest", "l2"), ("l2", "first", "b"), ("l2", "rest", "nil"), ("x", "sameAs", "y"), ("y", "sameAs", "z"), ("z", "sameAs", "x")]
    facts = spark.createDataFrame(cells, "s string, p string, o string")
    assert answers(owl.rdf_list(facts)) == [("l1", "a", 0), ("l1", "b", 1)]
    assert len(answers(owl.equivalents(facts, "sameAs"))) == 6
