"""Near duplicates against all pairs of a small table."""

from __future__ import annotations

import pytest

import brute
from thalweg.llm import near_duplicates


def as_dict(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}


def wanted(docs, width, part, of):
    return {d: (n, c, c == d) for d, (n, c) in brute.near_groups(docs, width, part, of).items()}


@pytest.mark.parametrize(("width", "part", "of"), [(3, 85, 100), (5, 80, 100)])
def test_groups_of_odd_documents(docs, odd_docs, width, part, of):
    texts = {i: t for i, (t, _, _) in odd_docs.items()}
    assert as_dict(near_duplicates.groups(docs, width, (part, of))) == wanted(texts, width, part, of)


def test_groups_of_the_drivers_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert as_dict(near_duplicates.groups(docs, 3, (85, 100))) == wanted(texts, 3, 85, 100)


def test_a_filter_of_bins_may_be_asked_for(spark, sf_dir):
    """The filter, which refuses links 3 times in 10^6, refuses none of these."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert as_dict(near_duplicates.groups(docs, 3, (85, 100), sigmas=4.5)) == as_dict(near_duplicates.groups(docs, 3, (85, 100), sigmas=None))


def test_ids_of_text(spark):
    one = "one river runs from the high snow down to the wide sea"
    docs = spark.createDataFrame([("b", one), ("a10", one), ("a9", one.upper()), ("z", "other words"), (None, one)], "doc_id string, text string")
    rows = near_duplicates.groups(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("None", "None", True), ("a10", "a10", True), ("a9", "a10", False), ("b", "a10", False), ("z", "z", True)]
    assert {r["doc_id"] for r in near_duplicates.deduplicate(docs).collect()} == {"a10", "z", None}


def test_texts_longer_than_a_slice(spark):
    """Texts of which one alone is more than a worker's slice: a copy with one word in 50 changed, and one that shares a half."""
    words = [f"w{k % 70_001}" for k in range(400_000)]
    near = ["stone" if k % 50 == 7 else w for k, w in enumerate(words)]
    texts = {1: " ".join(words), 2: " ".join(near), 3: " ".join(words[:40_000] + [f"v{k}" for k in range(60_000)]), 4: "short"}
    assert len(texts[1]) > near_duplicates.SLICE_BYTES
    found = as_dict(near_duplicates.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, (85, 100)))
    assert found == wanted(texts, 3, 85, 100)


def test_unlike_members_of_a_bucket_all_meet(spark):
    """No cap: a bucket whose members resemble one another only in pairs loses no link."""
    from pyspark.sql import functions as F

    from thalweg.llm.stars import star_links

    buckets, members = spark.range(40).select(F.lit(1).alias("bucket"), "id"), spark.range(40).select("id", (F.col("id") % 20).alias("kind"))
    links, named = star_links(buckets, members, lambda x, y: F.col(f"{x}_kind") == F.col(f"{y}_kind"), lambda pairs: pairs)
    assert sorted(map(tuple, links.collect())) == [(k, k + 20) for k in range(20)]
    assert dict(named.collect()) == {i: i % 20 for i in range(40)}


def test_a_large_group_costs_a_star(spark):
    """200 near copies make few candidates, not 20,000."""
    from pyspark.sql import functions as F

    from thalweg.llm.stars import star_links

    made = []

    def confirm(pairs):
        made.append(pairs.count())
        return pairs

    buckets = spark.range(200).select(F.lit(1).alias("bucket"), "id")
    _, named = star_links(buckets, spark.range(200), lambda x, y: F.lit(True), confirm)
    assert sum(made) == 199 and {r["component"] for r in named.collect()} == {0}


def test_deduplicate_keeps_rows_and_columns(docs, odd_docs):
    found = near_duplicates.deduplicate(docs)
    texts = {i: t for i, (t, _, _) in odd_docs.items()}
    assert found.columns == docs.columns
    assert {r["doc_id"] for r in found.collect()} == {d for d, (_, _, kept) in wanted(texts, 5, 80, 100).items() if kept}


def test_null_ids_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    rows = near_duplicates.groups(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"]) == [(1, 1), (1, 1), (2, 1)]
    assert len(rows) == 5


def test_empty(no_docs):
    assert near_duplicates.groups(no_docs).count() == 0


def test_unequal_bins_are_counted(spark):
    import numpy as np

    a, b = (np.random.default_rng(k).integers(0, 4, 120).astype("u8") for k in (1, 2))
    row = {f"{c}_print_{k}": int(v) for c, x in (("x", a), ("y", b)) for k, v in enumerate(near_duplicates.two_bits(x))}
    assert spark.createDataFrame([row]).select(near_duplicates.unequal_bins("x", "y", 4)).first()[0] == (a != b).sum()


def test_parities_bound_the_difference(spark):
    import numpy as np

    a, b = (np.unique(np.random.default_rng(k).integers(0, 2000, 300).astype("u8")) for k in (1, 2))
    row = {f"{c}_parity_{k}": int(v) for c, x in (("x", a), ("y", b)) for k, v in enumerate(near_duplicates.parities(x))}
    counted = spark.createDataFrame([row]).select(near_duplicates.unequal_parities("x", "y")).first()[0]
    flipped = np.bincount(np.setxor1d(a, b).astype("i8") % near_duplicates.PARITIES, minlength=near_duplicates.PARITIES) % 2
    assert counted == flipped.sum() <= len(np.setxor1d(a, b))
