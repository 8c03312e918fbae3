"""The registered queries: their columns, and their SQL."""

import pytest
from compare import same

from granary.llm import entry

COLUMNS = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op3_suffix_array_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op4_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_lm_scoring": {"doc_id": "bigint", "score": "double"},
    "op6_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op10_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op11_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op12_filter_audit": {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint")},
    "op13_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


def test_all_are_registered():
    assert set(entry.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, small, name):
    df = entry.queries()[name](spark, small)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, small, name):
    same(spark, small, entry.queries()[name], entry.oracle_sql()[name])
