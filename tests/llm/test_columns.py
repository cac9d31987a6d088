"""Operators that hand on rows leave docs' own columns as they were, whatever their names."""

from __future__ import annotations

import pytest

from thalweg.llm import decontamination, line_dedup, mixing, near_duplicates, quality, sharding

OWN = ["n_words", "hit_spans", "hit_items", "copies", "_size", "_id", "_source", "_words", "_copy", "size", "slot", "shard", "law", "text_crc32", "grown_shard", "_arc", "_bin", "_for", "_slot", "_cell", "_hash", "_rank", "_own", "_kept", "kept_id", "dropped_lines", "_doc", "part", "bucket", "keep", "own_column_3", "a.b", "c d", "n`o", "block", "kind"]
ROWS = [(1, "one river\nruns down the hill\nand on", "en", "b"), (2, None, None, None), (3, "", "de", "b"), (4, "stone upon stone upon stone", "en", "a"), (5, "stone upon stone upon stone", "en", "a"), (None, "stone of nobody", "en", None)]


@pytest.fixture
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join("`" + c.replace("`", "``") + "` int" for c in OWN)
    return spark.createDataFrame([(*r, *(100 * k + len(str(r[0])) for k in range(len(OWN)))) for r in ROWS], schema)


def rows(frame, columns=None):
    return sorted(map(repr, (tuple(r)[: columns or len(r)] for r in frame.collect())))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([("i", "nothing of this is there")], "item_id string, text string")


def test_own_columns_keep_their_values(docs, spark):
    every = rows(docs)
    good = quality.keep_good(docs, labels(spark))
    assert good.columns == docs.columns and set(rows(good)) <= set(every)
    for spans in (False, True):
        found = decontamination.decontaminate(docs, benchmark(spark), spans=spans)
        assert found.columns == docs.columns and rows(found) == every
    placed = sharding.shard(docs, 3)
    assert placed.columns[: len(docs.columns)] == docs.columns and rows(placed, len(docs.columns)) == every
    assert placed.columns[len(docs.columns) :] == ["size_", "text_crc32_", "law_", "shard_", "slot_", "grown_shard_"]
    lines = line_dedup.deduplicate_lines(docs.where("doc_id < 5 or doc_id is null"))
    assert lines.columns == docs.columns and rows(lines) == rows(docs.where("doc_id < 5 or doc_id is null"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and set(rows(mixed)) <= set(every)


def test_near_duplicates_of_null_ids_stay(docs):
    found = near_duplicates.deduplicate(docs)
    assert rows(found) == rows(docs.where("doc_id <> 5 or doc_id is null"))


def test_a_null_id_is_no_copy_of_others(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_duplicates.groups(docs).collect()) == [("1", "1", True), ("2", "1", False), ("2", "1", False), ("None", "None", True)]
    assert sorted(str(r["doc_id"]) for r in near_duplicates.deduplicate(docs).collect()) == ["1", "None"]


def test_removed_spans(spark):
    """Hit words go, from the documents that have some, and nothing else."""
    item = " ".join(f"w{k}" for k in range(13))
    docs = spark.createDataFrame([(1, f"before, {item} after."), (2, "clean"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, spark.createDataFrame([("i", item)], "item_id string, text string"), spans=True).collect()}
    assert found == {1: "before,  after.", 2: "clean", 3: None}
