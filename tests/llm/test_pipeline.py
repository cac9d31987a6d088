"""The corpus pipeline's stages, each on what the one before has kept."""

from __future__ import annotations

import pytest

import brute
from conftest import frame

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_the_drivers_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, stages = docs.columns, {}, dict(corpus_pipeline.STAGES)
    for k, (name, stage) in enumerate(stages.items()):
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = docs.persist()
        kept[name] = (before, docs)
        assert k == len(stages) - 1 or docs.columns == columns
    texts = {r["doc_id"]: r["text"] for r in kept["near-duplicate removal"][0].collect()}
    one = {d for d, (_, c) in brute.near_groups(texts, 5, 80, 100).items() if c == d}
    assert {r["doc_id"] for r in kept["near-duplicate removal"][1].collect()} == one
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = set()
    for d in one:
        n, hit, _ = brute.contamination(texts[d], items)
        if not (hit and 20 * hit >= n):
            clean.add(d)
    assert {r["doc_id"] for r in kept["benchmark decontamination"][1].collect()} == clean
    mixed, sharded = (kept[n][1] for n in ("source mixing", "sharding"))
    assert mixed.count() == sharded.count() > 0 and {r["doc_id"] for r in mixed.collect()} <= clean
    counts = [r["count"] for r in sharded.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    for _, out in kept.values():
        out.unpersist()


def test_the_whole_run(spark, sf_dir):
    """All stages after one another: shards of the mix of what is kept, the same when run again."""
    found = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard", "slot").collect()))
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert found and {d for d, _, _ in found} < ids
    slots = {}
    for _, shard, slot in found:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard", "slot").collect())) == found


def test_stages_take_empty_tables_and_own_columns(spark, sf_dir, odd_docs):
    for docs in (frame(spark, odd_docs), frame(spark, odd_docs).limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, docs, sf_dir)
            assert k == len(corpus_pipeline.STAGES) - 1 or found.columns == docs.columns
            assert found.count() >= 0
