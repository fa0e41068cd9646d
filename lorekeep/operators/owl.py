"""RDFS and OWL questions over a table of facts (s, p, o): class expressions, equivalence, disjointness, lists, properties.

Predicates are short names: type, subClassOf, onProperty, someValuesFrom and so on. Results are DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.taxonomy import reach


def facts_of(facts: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    return facts.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def instances(facts: DataFrame) -> DataFrame:
    """(s, cls): every individual with its classes and their superclasses."""
    types = facts_of(facts, "type", "s", "cls")
    up = reach(facts_of(facts, "subClassOf", "src", "dst")).select(F.col("src").alias("cls"), F.col("dst").alias("sup"))
    return types.unionByName(types.join(up, "cls").select("s", F.col("sup").alias("cls"))).distinct()


def members(facts: DataFrame, cls: str) -> DataFrame:
    """(s): the individuals of one class and of those below it; only these classes' closure is made."""
    down = facts_of(facts, "subClassOf", "dst", "src").select("src", "dst")
    start = facts.sparkSession.createDataFrame([(cls,)], "src string")
    below = reach(down, reflexive=True, start=start).select(F.col("dst").alias("cls"))
    return facts_of(facts, "type", "s", "cls").join(below, "cls", "left_semi").select("s").distinct()


def symmetric(facts: DataFrame, p: str) -> DataFrame:
    pairs = facts_of(facts, p, "a", "b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def equivalents(facts: DataFrame, p: str = "equivalentClass") -> DataFrame:
    """(a, b): the symmetric and transitive closure, without a itself; p can be sameAs as well."""
    return reach(symmetric(facts, p).select(F.col("a").alias("src"), F.col("b").alias("dst"))).where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def inverses(facts: DataFrame) -> DataFrame:
    return symmetric(facts, "inverseOf")


def rdf_list(facts: DataFrame) -> DataFrame:
    """(head, pos, item): the elements of every list, in order; heads are nodes no other node's rest leads to."""
    rest, first = facts_of(facts, "rest", "src", "dst"), facts_of(facts, "first", "node", "item")
    heads = first.select(F.col("node").alias("src")).join(rest.select(F.col("dst").alias("src")), "src", "left_anti").distinct()
    chain = reach(rest, reflexive=True, start=heads)
    return chain.select(F.col("src").alias("head"), F.col("depth").alias("pos"), F.col("dst").alias("node")).join(first, "node").select("head", "pos", "item")


def disjoint(facts: DataFrame) -> DataFrame:
    """(a, b): classes that are declared disjoint, alone or in a list of all-disjoint classes, or whose superclasses are."""
    direct = symmetric(facts, "disjointWith")
    lists = facts_of(facts, "members", "set", "head").join(rdf_list(facts), "head").select("set", "item")
    members = lists.select("set", F.col("item").alias("a")).join(lists.select("set", F.col("item").alias("b")), "set").where("a <> b").select("a", "b")
    both = direct.unionByName(members).distinct()
    up = reach(facts_of(facts, "subClassOf", "src", "dst"), reflexive=True).select("src", "dst")
    below = both.join(up.withColumnsRenamed({"src": "x", "dst": "a"}), "a", "left").withColumn("x", F.coalesce("x", "a"))
    below = below.join(up.withColumnsRenamed({"src": "y", "dst": "b"}), "b", "left").withColumn("y", F.coalesce("y", "b"))
    return below.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def some_values(facts: DataFrame, prop: str, cls: str) -> DataFrame:
    """(s): individuals with a value of the class."""
    of_class = members(facts, cls).select(F.col("s").alias("o"))
    return facts_of(facts, prop).join(of_class, "o", "left_semi").select("s").distinct()


def all_values(facts: DataFrame, prop: str, cls: str) -> DataFrame:
    """(s): individuals with values, all of the class (closed world)."""
    of_class = members(facts, cls).select(F.col("s").alias("o"))
    values = facts_of(facts, prop)
    return values.select("s").distinct().join(values.join(of_class, "o", "left_anti").select("s").distinct(), "s", "left_anti")


def has_value(facts: DataFrame, prop: str, value: str) -> DataFrame:
    return facts_of(facts, prop).where(F.col("o") == value).select("s").distinct()


def cardinality(facts: DataFrame, prop: str, at_least: int = 0, at_most: int | None = None, cls: str | None = None) -> DataFrame:
    """(s, n): subjects whose number of distinct values (of the class, if given) lies in the bounds; with at_least 0, also
    individuals with a type and no such values."""
    values = facts_of(facts, prop)
    if cls:
        values = values.join(members(facts, cls).select(F.col("s").alias("o")), "o", "left_semi")
    counted = values.groupBy("s").agg(F.countDistinct("o").alias("n"))
    if at_least == 0:
        none = facts_of(facts, "type").select("s").distinct().join(values, "s", "left_anti").withColumn("n", F.lit(0).cast("long"))
        counted = counted.unionByName(none)
    counted = counted.where(F.col("n") >= at_least)
    return counted if at_most is None else counted.where(F.col("n") <= at_most)


def union_of(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("s")
    for p in parts[1:]:
        out = out.union(p.select("s"))
    return out.distinct()


def intersection_of(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("s").distinct()
    for p in parts[1:]:
        out = out.join(p.select("s").distinct(), "s", "left_semi")
    return out


def complement_of(facts: DataFrame, part: DataFrame) -> DataFrame:
    """Individuals with a type that aren't in the part."""
    return facts_of(facts, "type").select("s").distinct().join(part.select("s").distinct(), "s", "left_anti")


def chain(facts: DataFrame, *props: str, parts: int | None = None) -> DataFrame:
    """(s, o): property chains, one equi-join a link. With parts, joins and results are dealt to so many tasks, whatever the
    session's number of shuffle partitions."""
    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(parts, *keys) if parts else df

    out = facts_of(facts, props[0])
    for p in props[1:]:
        out = dealt(out.withColumnRenamed("o", "m"), "m").join(facts_of(facts, p, "m", "o"), "m").select("s", "o")
    return dealt(out, "s", "o").distinct()


def rename(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Facts with s, p and o renamed by a table (old, new); names without an entry stay."""
    for c in ("s", "p", "o"):
        facts = facts.join(names.select(F.col("old").alias(c), F.col("new").alias("__new")), c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return facts


def expression(facts: DataFrame, expr: object) -> DataFrame:
    """(s): the individuals of a class expression: a class name, ("and", …), ("or", …), ("not", x), ("only", p, x),
    ("some", p, x), ("value", p, v), ("min" | "max" | "exactly", p, n) or with a class name behind."""
    if isinstance(expr, str):
        return members(facts, expr)
    kind, *rest = expr
    if kind in ("and", "or"):
        return (intersection_of if kind == "and" else union_of)(*(expression(facts, x) for x in rest))
    if kind == "not":
        return complement_of(facts, expression(facts, rest[0]))
    if kind == "value":
        return has_value(facts, *rest)
    if kind in ("some", "only"):
        values, inner = facts_of(facts, rest[0]), expression(facts, rest[1]).select(F.col("s").alias("o"))
        if kind == "some":
            return values.join(inner, "o", "left_semi").select("s").distinct()
        every = values.select("s").union(facts_of(facts, "type").select("s")).distinct()  # without values, all of them are
        return every.join(values.join(inner, "o", "left_anti").select("s").distinct(), "s", "left_anti")
    low, high = {"min": (rest[1], None), "max": (0, rest[1]), "exactly": (rest[1], rest[1])}[kind]
    return cardinality(facts, rest[0], low, high, rest[2] if len(rest) > 2 else None).select("s")


def read_expression(facts: DataFrame, cls: str) -> object:
    """A named class's expression as its facts state it (intersectionOf, unionOf, complementOf, restrictions), or the name.

    An expression is as large as an axiom, not as the data: its nodes come to the driver level by level.
    """
    lists = {"intersectionOf": "and", "unionOf": "or"}
    parts = {r.p: r.o for r in facts.where((F.col("s") == cls) & F.col("p").isin(*lists, "complementOf", "onProperty", "someValuesFrom", "allValuesFrom", "hasValue", "minCardinality", "maxCardinality", "cardinality", "onClass", "equivalentClass")).select("p", "o").collect()}
    for p, kind in lists.items():
        if p in parts:
            items, node = [], parts[p]
            while node != "nil":
                cell = {r.p: r.o for r in facts.where(F.col("s") == node).select("p", "o").collect()}
                items.append(read_expression(facts, cell["first"]))
                node = cell["rest"]
            return (kind, *items)
    if "complementOf" in parts:
        return ("not", read_expression(facts, parts["complementOf"]))
    prop = parts.get("onProperty")
    if prop:
        for p, kind in (("someValuesFrom", "some"), ("allValuesFrom", "only")):
            if p in parts:
                return (kind, prop, read_expression(facts, parts[p]))
        if "hasValue" in parts:
            return ("value", prop, parts["hasValue"])
        kind, n = next((k, int(parts[p])) for p, k in (("minCardinality", "min"), ("maxCardinality", "max"), ("cardinality", "exactly")) if p in parts)
        return (kind, prop, n, parts["onClass"]) if "onClass" in parts else (kind, prop, n)
    return read_expression(facts, parts["equivalentClass"]) if "equivalentClass" in parts else cls


# Names of vocabulary terms and the kinds that they declare.
KINDS = {"Class": "class", "Restriction": "restriction", "ObjectProperty": "object_property", "DatatypeProperty": "data_property", "AnnotationProperty": "annotation_property", "NamedIndividual": "individual", "AllDisjointClasses": "all_disjoint_classes"}


def kinds(facts: DataFrame) -> DataFrame:
    """(s, kind): what a term is declared as; unionOf, intersectionOf and complementOf tell of classes too."""
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    declared = facts_of(facts, "type", "s", "cls").select("s", F.try_element_at(names, "cls").alias("kind")).where("kind IS NOT NULL")
    built = facts.where(F.col("p").isin("unionOf", "intersectionOf", "complementOf")).select("s", F.concat(F.lit("class_"), F.lower(F.regexp_replace("p", "Of$", ""))).alias("kind"))
    return declared.unionByName(built).distinct()


def domains_and_ranges(facts: DataFrame) -> DataFrame:
    """(p, kind, cls): declared domains and ranges, a property's own and those of the properties above it."""
    up = reach(facts_of(facts, "subPropertyOf", "src", "dst"))
    own = facts.where("p IN ('domain', 'range')").select(F.col("s").alias("prop"), F.col("p").alias("kind"), F.col("o").alias("cls"))
    above = own.join(up.select(F.col("dst").alias("prop"), "src"), "prop").select(F.col("src").alias("prop"), "kind", "cls")
    return own.unionByName(above).distinct().withColumnRenamed("prop", "p")


def missing(facts: DataFrame, cls: str, prop: str) -> DataFrame:
    """(s): individuals of a class without any value of a property: a validation rule."""
    return members(facts, cls).join(facts_of(facts, prop).select("s").distinct(), "s", "left_anti")


def ill_typed(facts: DataFrame) -> DataFrame:
    """(s, p, o, kind, cls): facts whose subject lacks the domain, or whose object has types but not the range, of their property."""
    has = instances(facts)
    declared = domains_and_ranges(facts)
    used = facts.select("s", "p", "o").join(declared, "p")
    node = F.when(F.col("kind") == "domain", F.col("s")).otherwise(F.col("o"))
    known = has.select(F.col("s").alias("node")).distinct()
    judged = used.withColumn("node", node).join(known, "node", "left_semi")
    return judged.join(has.select(F.col("s").alias("node"), "cls"), ["node", "cls"], "left_anti").select("s", "p", "o", "kind", "cls")
