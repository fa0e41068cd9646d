"""The pipeline's stages on a small corpus, each against what its input holds."""

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, lines=4):
    rng = np.random.default_rng(seed)
    return "\n".join(" ".join(WORDS[i] + str(int(j)) for i, j in zip(rng.integers(0, 20, 30), rng.integers(0, 50, 30), strict=True)) for _ in range(lines))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    item = text(999, 1)
    rows = [(i, text(i), "en", f"s{i % 3}", i) for i in range(40)]
    rows += [(100 + i, text(500 + i, 1).upper().replace(" ", "### ") + "\n" + text(600 + i, 3).upper().replace(" ", "### "), "en", "junk", 0) for i in range(40)]
    rows += [(200, text(0), "en", "s0", 0), (201, text(1).replace("\n", " ").replace("alpha", "omega", 1), "en", "s0", 0), (202, text(1).replace("\n", " "), "en", "s0", 0)]
    rows += [(300, text(301) + "\n" + item + "\nend", "en", "s1", 0), (301, None, None, None, None), (302, "", "en", "s", 0), (None, text(303), None, None, None), (304, text(304), "en", "s", 0), (304, text(304), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(r[3] != "junk"), 0) for r in rows[:80] if r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns or name == "packing"
    clean = {*range(40), 304, None}
    assert seen["quality_rules"] == clean | {200, 201, 202, 300}
    assert seen["line_dedup"] == clean | {201, 202, 300}  # 200 is a copy: no line of it stays
    assert seen["near_dedup"] == clean | {300}  # 201 and 202 are nearly 1
    assert seen["benchmark_decontamination"] == clean
    assert seen["packing"] == seen["benchmark_decontamination"]
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_stages_on_an_empty_table_and_with_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS kept", "2 AS n_dropped", "3 AS w", "4 AS row", "5 AS __kept", "6 AS component_id", "7 AS items", "8 AS __id", "9 AS __text", "10 AS hits")
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table, folder)
            assert got.columns == table.columns
            assert (got.count() > 0) == (table is odd), name
        assert (corpus_pipeline.STAGES[-1][1](spark, table, folder).count() > 0) == (table is odd)


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
