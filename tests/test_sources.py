"""Readers of RDF files, typed literals, imports and names."""

import pytest

from lorekeep.sources import rdf

T = "http://x.org/t#"


def rows(df):
    return {(r.s, r.p, r.o_kind, r.o) for r in df.collect()}


def test_ntriples(spark, tmp_path):
    path = tmp_path / "a.nt"
    path.write_text(
        "# a comment\n<http://x/a> <http://x/p> <http://x/b> .\n<http://x/a> <http://x/q> \"say \\\"hi\\\"\\n\"@en .\n_:n1 <http://x/age> \"42\"^^<http://www.w3.org/2001/XMLSchema#integer> .\n"
        "<http://x/a> <http://x/p> _:n1 <http://x/graph> .\nnot a line\n"
    )
    df = rdf.load(spark, str(path))
    assert rows(df) == {("http://x/a", "http://x/p", "iri", "http://x/b"), ("http://x/a", "http://x/q", "lit", 'say "hi"\n'), ("_:n1", "http://x/age", "lit", "42"), ("http://x/a", "http://x/p", "blank", "_:n1")}
    assert [r.o_num for r in df.where("p LIKE '%age'").collect()] == [42.0] and {r.graph for r in df.collect()} == {"default", "http://x/graph"}
    assert [r.value for r in rdf.typed(df, "integer").collect()] == [42]


XML = """<rdf:RDF xml:base="http://x.org/t" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:t="http://x.org/t#" xmlns:owl="http://www.w3.org/2002/07/owl#">
<owl:Ontology rdf:about="http://x.org/t"><owl:imports rdf:resource="http://x.org/base"/></owl:Ontology>
<t:Man rdf:about="#Fred"><t:hasSibling rdf:resource="http://x.org/t#Ernest"/><t:hasAge rdf:datatype="http://www.w3.org/2001/XMLSchema#int">34</t:hasAge>
<t:owns><t:Car rdf:ID="Red"/></t:owns><t:likes rdf:parseType="Collection"><rdf:Description rdf:about="#A"/><rdf:Description rdf:about="#B"/></t:likes></t:Man></rdf:RDF>"""


def test_rdf_xml_and_imports(spark, tmp_path):
    (tmp_path / "t.owl").write_text(XML)
    (tmp_path / "base.ttl").write_text('@prefix b: <http://x.org/b#> .\nb:Thing a b:Class ; b:label "a \\"thing\\""@en , \'x\' .')
    df, loaded = rdf.load_with_imports(spark, str(tmp_path / "t.owl"), lambda iri: str(tmp_path / "base.ttl") if iri == "http://x.org/base" else None)
    found = rows(df)
    assert loaded == [str(tmp_path / "t.owl"), str(tmp_path / "base.ttl")]
    assert {(T + "Fred", rdf.RDF + "type", "iri", T + "Man"), (T + "Fred", T + "hasSibling", "iri", T + "Ernest"), (T + "Fred", T + "hasAge", "lit", "34"), (T + "Fred", T + "owns", "iri", T + "Red"), (T + "Red", rdf.RDF + "type", "iri", T + "Car")} <= found
    assert sorted(o for s, p, k, o in found if p == rdf.RDF + "first") == [T + "A", T + "B"] and sum(p == rdf.RDF + "rest" for s, p, k, o in found) == 2
    facts, notes = rdf.split_annotations(df, ["http://x.org/b#label"])
    assert notes.count() >= 1 and facts.where("p = 'http://x.org/b#label'").count() == 0


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('PREFIX t: <http://x.org/t#>\nt:Fred a t:Man ; # who\n t:hasAge 34 , "x"^^t:odd ; t:knows _:b1, <http://y/z> ; t:big true .\n_:b1 t:name """two\nlines""" .')
    df = rdf.load(spark, str(tmp_path / "a.ttl"))
    assert {(T + "Fred", rdf.RDF + "type", "iri", T + "Man"), (T + "Fred", T + "hasAge", "lit", "34"), (T + "Fred", T + "knows", "iri", "http://y/z"), (T + "Fred", T + "big", "lit", "true"), ("_:a_ttl_b1", T + "name", "lit", "two\nlines")} <= rows(df)


def test_long_literals_and_escapes(spark, tmp_path):
    long = "x" * 300_000
    (tmp_path / "a.nt").write_text(f'<s> <p> "{long}" .\n<s> <q> "C:\\\\new \\u00e9\\t\\U0001F600\\b" .\n# note\n\n<s> <p> "open .\n')
    df = rdf.load(spark, str(tmp_path / "a.nt"))
    assert {r.p: r.o for r in df.collect()} == {"p": long, "q": "C:\\new \u00e9\t\U0001f600\b"}
    assert [r.value for r in rdf.malformed(spark, str(tmp_path / "a.nt")).collect()] == ['<s> <p> "open .']


def test_nested_turtle_and_trig(spark, tmp_path):
    (tmp_path / "a.trig").write_text("@prefix t: <http://x.org/t#> .\n@base <http://b/> .\nt:a t:p [ t:q 'one' , \"tw\\u00e9\"@en ; t:r ( t:x 1.5 ) ] .\nt:g { t:a t:s <rel> } GRAPH <http://g/2> { t:b a t:C . [] t:u true . }\n() t:v 2e3 .")
    df = rdf.load(spark, str(tmp_path / "a.trig"))
    found = {(r.s.replace("_:a_trig_", ""), r.p.rsplit("#", 1)[-1], r.o.rsplit("#", 1)[-1].replace("_:a_trig_", ""), r.graph.rsplit("/", 1)[-1].rsplit("#", 1)[-1]) for r in df.collect()}
    wanted = {("http://x.org/t#a", "p", "b1", "default"), ("b1", "q", "one", "default"), ("b1", "q", "tw\u00e9", "default"), ("b1", "r", "b2", "default"), ("b2", "first", "x", "default"), ("b2", "rest", "b3", "default"), ("b3", "first", "1.5", "default"), ("b3", "rest", "nil", "default")}
    wanted |= {("http://x.org/t#a", "s", "http://b/rel", "g"), ("http://x.org/t#b", "type", "C", "2"), ("b4", "u", "true", "2"), (rdf.RDF + "nil", "v", "2e3", "default")}
    assert found == wanted
    (tmp_path / "bad.ttl").write_text("<http://a> <http://b> <http://c> .\n<http://a> ? <http://c> .")
    with pytest.raises(Exception, match="line 2"):
        rdf.load(spark, str(tmp_path / "bad.ttl")).collect()


def test_names_and_writing(spark, tmp_path):
    assert rdf.origin("/a/b/swrl_test.owl") == "swrl_test" and rdf.version("/onto/v1.2.3/a.owl") == "v1.2.3" and len(rdf.version("/onto/a.owl")) == 10
    df = spark.createDataFrame([("a", "p", "1"), ("b", "q", "2")], "s string, p string, o string")
    rdf.write(df, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store")).where("p = 'q'")
    assert [(r.s, r.o) for r in back.collect()] == [("b", "2")] and "PartitionFilters: [isnotnull(p" in back._jdf.queryExecution().toString()
