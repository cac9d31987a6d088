"""The registered queries give a row for each of their tables (those with SQL are compared with it in tests/test_oracles.py)."""

from __future__ import annotations

import pytest

from thalweg.llm import queries

DIGESTS = {
    "op1_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op3_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_html_text": {"page_id", "url", "text", "n_chars"},
    "op5_quality": {"doc_id", "keep", "perplexity"},
    "op8_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op9_line_dedup": {"doc_id", "n_lines", "n_dropped"},
}


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_query_has_a_row_for_each_of_its_table(spark, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir)
    assert DIGESTS[name] <= set(found.columns)
    key, table = ("page_id", "pages") if "page_id" in found.columns else ("doc_id", "documents")
    wanted = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)
    assert sorted(r[0] for r in found.select(key).collect()) == sorted(r[0] for r in wanted.collect())
