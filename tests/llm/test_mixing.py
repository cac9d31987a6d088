"""Pivotal rounding: targets, the bound of three, totals near targets, reruns."""

from __future__ import annotations

from collections import defaultdict

import pytest

import brute
from thalweg.llm import mixing


@pytest.mark.parametrize("chunk", [4096, 3])
def test_mix_of_odd_documents(docs, odd_docs, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = {r["doc_id"]: r for r in mixing.mix_sizes(docs).collect()}
    sizes = defaultdict(int)
    for i, (text, _, source) in odd_docs.items():
        assert rows[i]["size"] == len(brute.SPACED.findall(text or ""))
        sizes[source] += rows[i]["size"]
    want, taken, most = brute.targets(sizes), defaultdict(int), defaultdict(int)
    for i, (_, _, source) in odd_docs.items():
        r = rows[i]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source], rel=1e-9)
        assert r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        most[source] = max(most[source], r["size"])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
    assert sum(want.values()) == pytest.approx(min(sum(sizes.values()), 3 * sum(sizes.values())))


def test_reruns_agree_whatever_the_partitions(docs):
    first = sorted(map(str, mixing.mix_sizes(docs).collect()))
    assert sorted(map(str, mixing.mix_sizes(docs.repartition(5, "text")).collect())) == first


def test_mix_gives_whole_rows(docs):
    mixed, sizes = mixing.mix(docs), {r["doc_id"]: r for r in mixing.mix_sizes(docs).collect()}
    assert mixed.columns == docs.columns
    counts = dict(mixed.groupBy("doc_id").count().collect())
    assert counts == {i: r["taken"] // r["size"] for i, r in sizes.items() if r["taken"]}


def test_pivot_keeps_each_pairs_words():
    import random

    words, fractions = [5, 3, 8, 2], [0.4, 0.7, 0.25, 0.5]
    total = sum(w * f for w, f in zip(words, fractions, strict=True))
    left = mixing.pivot(words, fractions, random.Random(1).random)
    assert sum(0 < f < 1 for f in fractions) == (left is not None)
    assert sum(w * f for w, f in zip(words, fractions, strict=True)) == pytest.approx(total)


def test_pivot_is_unbiased():
    import random

    draw, sums = random.Random(2).random, [0.0, 0.0, 0.0]
    for _ in range(4000):
        f = [0.3, 0.5, 0.6]
        left = mixing.pivot([4, 2, 7], f, draw)
        if left is not None:
            f[left] = float(draw() < f[left])
        sums = [a + b for a, b in zip(sums, f, strict=True)]
    assert [x / 4000 for x in sums] == pytest.approx([0.3, 0.5, 0.6], abs=0.03)


def test_empty_and_wordless(spark, no_docs):
    assert mixing.mix_sizes(no_docs).count() == 0
    rows = mixing.mix_sizes(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["taken"], r["target"]) for r in rows] == [(0, 0.0), (0, 0.0)]


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 3 + [(2, "c", "t")], "doc_id long, text string, source string")
    assert mixing.mix_sizes(docs).count() == 4
