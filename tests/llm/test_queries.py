"""The corpus queries with SQL against it, and the others' columns."""

import pytest

from lorekeep.llm import oracles, queries
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="no test data")
COLUMNS = {
    "op1": "page_id url text n_chars", "op2": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op3": "doc_id n_lines n_dropped kept_sha256", "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op5": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6": "doc_id held_out lang_pred score", "op7": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op8": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9": "doc_id n_shingles component_id kept", "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, name):
    oracle.compare(queries.queries()[name](spark, oracle.FOLDER), oracle.connect(), oracles.ORACLES[name])


@pytest.mark.parametrize("name", list(queries.queries()))
def test_columns(spark, name):
    df = queries.queries()[name](spark, oracle.FOLDER)
    wanted = COLUMNS[name.split("_")[0]].split()
    assert df.columns[: len(wanted)] == wanted


def test_language_accuracy_on_the_held_out_fold(spark):
    found = queries.op6_language(spark, oracle.FOLDER).join(spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count() > 0


def test_quality_follows_the_labels(spark):
    judged = queries.op10_quality(spark, oracle.FOLDER).join(spark.read.parquet(f"{oracle.FOLDER}/labels.parquet"), "doc_id").where("NOT base_failed")
    assert judged.where("quality = 1 AND NOT kept").count() <= 0.02 * judged.where("quality = 1").count()
