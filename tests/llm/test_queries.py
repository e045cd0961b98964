"""Registered queries beside their SQL, and what each must return."""

import pytest

from tests.compare import connect, difference, spark_result, sql_result
from tidemark.llm.queries import QUERIES, SQL

COLUMNS = {
    1: "doc_id n_words n_base first_word last_word base_labels labels score",
    2: "doc_id start n_tokens ids_crc32",
    3: "page_id url text n_chars",
    4: "doc_id size source_size target taken",
    5: "doc_id held_out n_tokens n_known train_tokens base_score score",
    6: "doc_id fingerprint component_id",
    7: "doc_id held_out score predicted",
    8: "doc_id size text_crc32 law shard slot grown_shard",
    9: "query_id rank vec_id score",
    10: "doc_id n_words n_hit n_items items_sha256 contaminated",
    11: "anchor_id positive_id rank negative_id positive_score negative_score",
    12: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    13: "word form root n n_near form_n",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    assert difference(spark_result(QUERIES[name](spark, sf_dir)), sql_result(connect(sf_dir), SQL[name])) is None


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in ("op8", "op4", "op3", "op11", "op12", "op13")])
def test_columns(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[int(name[2:].split("_")[0])].split()) <= set(found.columns)


@pytest.mark.parametrize("name", ["op8_minimax_shards", "op12_trusted_ratio"])
def test_native_operators_have_no_python(spark, sf_dir, name):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
