"""Hits of benchmark windows against plain search."""

from __future__ import annotations

import hashlib

import pytest

import brute
from thalweg.llm import decontamination

PASSAGE = "The quick brown fox jumps over the lazy dog while fourteen grey herons watch from the old stone bridge"
ITEMS = [("i1", PASSAGE), ("i2", "just five words in here"), ("i3", None), ("i4", "..."), ("i5", PASSAGE + " again"), ("i5", "über naïve 水 words")]
TEXTS = {
    0: None, 1: "", 2: "?!", 3: PASSAGE, 4: PASSAGE.upper().replace(" ", "--"), 5: "x " * 300 + PASSAGE, 6: "x " * 200 + PASSAGE, 7: PASSAGE[:60],
    8: "before JUST five, words in here after", 9: "w " + PASSAGE + " again " + PASSAGE, 10: "über naïve 水 words", 11: " ".join(PASSAGE.split()[3:16]), 12: "y " * 5000,
}


def wanted(texts, items):
    for d, t in texts.items():
        n, hit, ids = brute.contamination(t, [x for x in items if x[0] is not None])
        yield d, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= n


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in TEXTS.items()], "doc_id long, text string, n_words int, hit_spans string").repartition(3)
    return docs, spark.createDataFrame([*ITEMS, (None, "y y y")], "item_id string, text string")


@pytest.mark.parametrize("block", [1_000_000, 10])
def test_digests(tables, block):
    found = decontamination.digests(decontamination.find_hits(*tables, block_words=block))
    assert sorted(map(tuple, found.collect())) == list(wanted(TEXTS, ITEMS))


def test_digests_of_the_drivers_documents(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontamination.digests(decontamination.find_hits(docs.select("doc_id", "text"), items))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = list(wanted(texts, [(str(r["item_id"]), r["text"]) for r in items.collect()]))
    assert sorted(map(tuple, found.collect())) == sorted(want) and any(w[-1] for w in want)


def test_documents_go(tables):
    docs, items = tables
    stays = {w[0] for w in wanted(TEXTS, ITEMS) if not w[-1]}
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == stays


def test_spans_go(tables):
    docs, items = tables
    found = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items, spans=True).collect()}
    assert found[0] is None and found[3] == "" and found[8] == "before  after" and found[12] == TEXTS[12]
    assert all(brute.contamination(t, ITEMS)[1] == 0 for d, t in found.items() if d not in (9,))


def test_empty_tables(tables):
    docs, items = tables
    assert decontamination.find_hits(docs.limit(0), items).count() == 0
    assert {r["contaminated"] for r in decontamination.digests(decontamination.find_hits(docs, items.limit(0))).collect()} == {False}
