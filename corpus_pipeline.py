"""The corpus pipeline: raw documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of documents. SQL can't express the first and the last stage, so ORACLE_SQL is None and
the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import decontaminate, line_dedup, near_dup, packing, quality
from lorekeep.llm.common import materialize, read

ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns but the text in one more, so that no name can clash."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _unpacked(done: DataFrame, docs: DataFrame) -> DataFrame:
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go. Labels are those of the folder's table."""
    field = quality.fit(docs, read(spark, sf_dir, "labels"))
    return _unpacked(quality.judge(_packed(docs), field).where("kept"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and so do documents that had words and have none left: they were copies."""
    done = line_dedup.dedup_lines(_packed(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_dropped") == 0))
    return _unpacked(done, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8 or more, smallest doc_id."""
    kept = near_dup.near_duplicates(docs, shingle=5, percent=80).where("kept").select("doc_id").distinct().alias("k")
    return docs.alias("d").join(kept, F.expr("CAST(d.doc_id AS BIGINT) <=> k.doc_id"), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, each with the sources' shares of the whole."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
