"""The n-gram model against a plain one, and its decisions on held-out labels."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest

import brute
from thalweg.llm import quality

TEXTS = ["the river runs", "the rain rains on the river", "a stone", "über die Brücke", "", None, "水の流れ 😀", "\x00odd\x00"]


def model(texts, order):
    def cuts(counts):
        n1, n2, n3, n4 = (sum(n == k for n in counts.values()) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return 0.5, 1.0, 1.5
        y = n1 / (n1 + 2 * n2)
        return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))

    return brute.kneser_ney(texts, order, cuts)


def scored(spark, order, block_bytes):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, gram string").repartition(3)
    flags = spark.createDataFrame([(i, quality.TRUSTED) for i in range(3)], "doc_id long, flag int")
    return {r["doc_id"]: r for r in quality.likelihoods(docs, flags, order, block_bytes).collect()}


@pytest.mark.parametrize("block", [1 << 26, 7])
def test_likelihoods_equal_a_plain_model(spark, block):
    order = 3
    trusted = [t for t in TEXTS[:3] if t]
    found = scored(spark, order, block)
    p = model(trusted, order)
    for i, t in enumerate(TEXTS):
        padded = "\x02" * (order - 1) + (t or "")
        want = sum(math.log(p(padded[k : k + order])) for k in range(len(t or "")))
        assert found[i]["log_p"] == pytest.approx(want, rel=1e-6, abs=1e-6) and found[i]["n_chars"] == len(t or "")


def test_toxicity_equals_a_plain_model(spark):
    order, texts = 3, ["the river runs", "the rain rains", "a stone", "the foul river fouls", "foul stone", None, ""]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    flags = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 2)], "doc_id long, flag int")
    found = {r["doc_id"]: r["toxicity"] for r in quality.likelihoods(docs, flags, order).collect()}
    p, pad = model(texts[:3], order), "\x02" * (order - 1)
    toxic = Counter((pad + texts[3])[k : k + order] for k in range(len(texts[3])))
    for i, t in enumerate(texts):
        padded, want = pad + (t or ""), 0.0
        grams = [padded[k : k + order] for k in range(len(t or ""))]
        ratios = [math.log((toxic[g] / p(g) + quality.TOXIC_PRIOR) / (sum(n for x, n in toxic.items() if x[:-1] == g[:-1]) + quality.TOXIC_PRIOR)) for g in grams]
        for m in re.finditer(r"\S+", t or ""):
            want += math.log(1 + quality.TOXIC_WORDS * (math.exp(sum(ratios[m.start() : m.end()])) - 1))
        assert found[i] == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_long_texts_are_scored_in_slices(spark, monkeypatch):
    """Slices, packs and blocks change nothing: these settings hold in the driver's own run of the functions."""
    import pyarrow as pa

    r = random.Random(2)
    text = " ".join(r.choices(TEXTS[0].split() + ["x" * 400], k=3000))
    monkeypatch.setattr(quality, "SCORED_CHARS", 5000)
    monkeypatch.setattr(quality, "LOOK_BACK", 300)
    flat, _ = quality.characters([text], 3)
    seen, grams = [], 0
    for part, begins in quality._slices([text], 3):
        grams += len(part) - 2
        seen.append(part[2:])
    assert len(seen) > 3 and grams == len(text)
    assert "".join(chr(c) for part in seen for c in part) == text
    b = pa.RecordBatch.from_pydict({"block": pa.array([0, 1, 0], pa.int32()), "doc_id": [1, None, 3], "lang": ["a", None, "b"], "text": pa.array([text.encode(), None, b"x"], pa.binary())})
    packed = [p for batch in quality._packer([b]) for p in batch.to_pylist()]
    assert sorted((p["block"], p["ids"], p["langs"], p["sizes"]) for p in packed) == [(0, [1, 3], ["a", "b"], [len(text), 1]), (1, [None], [None], [0])]


def test_probabilities_of_a_context_sum_to_one_at_most():
    p = model(["abab", "abc"], 2)
    assert sum(p("a" + c) for c in "abc") <= 1 + 1e-9


def test_held_out_documents(spark, sf_dir):
    """Fitted on half of the labels, it keeps the good documents of the other half and rejects the bad ones."""
    sf_dir = Path(sf_dir).with_name("sf0.01")
    if not sf_dir.exists():
        pytest.skip("the larger tables are not here")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r["keep"] for r in quality.scores(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good = [found[r["doc_id"]] for r in held if r["quality"] == 1 and not r["toxic"]]
    bad = [found[r["doc_id"]] for r in held if r["quality"] == 0]
    assert sum(good) >= 0.95 * len(good)
    assert sum(bad) <= 0.15 * len(bad)


def test_odd_documents(docs, odd_docs, spark):
    labels = spark.createDataFrame([(i, 1, None, "z") for i in odd_docs] + [(0, 0, 0, "z"), (None, 1, 0, "z")], "doc_id long, quality int, toxic int, keep string")
    found = {r["doc_id"]: r for r in quality.scores(docs, labels).collect()}
    assert found.keys() == odd_docs.keys()
    assert all(found[i]["keep"] is True for i, (t, _, _) in odd_docs.items() if not t)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["keep"]}


def test_without_trusted_text_all_stay(docs, spark, odd_docs):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels).count() == len(odd_docs)
    assert quality.keep_good(docs, labels.limit(0)).count() == len(odd_docs)


def test_empty(no_docs, spark):
    assert quality.scores(no_docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_toxic_labels_are_not_trusted(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r[0] for r in quality.trusted_ids(labels).collect()} == {1, 4}


@pytest.mark.parametrize("block", [1 << 26, 7])
def test_worst_words_equal_a_plain_model(spark, block):
    order = 3
    found = scored(spark, order, block)
    p = model([t for t in TEXTS[:3] if t], order)
    for i, t in enumerate(TEXTS):
        padded = "\x02" * (order - 1) + (t or "")
        logs = [math.log(p(padded[k : k + order])) for k in range(len(t or ""))]
        means = [sum(logs[m.start() : m.end()]) / len(m[0]) for m in re.finditer(r"\S{4,}", t or "")]
        assert found[i]["worst"] == (pytest.approx(min(means), rel=1e-5) if means else None)


def test_a_few_words_in_good_prose_reject(spark):
    """Documents of which only one word is not as in trusted text."""
    r = random.Random(3)
    prose = lambda: " ".join(r.choices(["river", "stone", "water", "runs", "down", "hill", "the", "over"], k=300))
    texts = {k: prose() for k in range(200)} | {k: prose() + " zqxwvkj " + prose() for k in range(200, 220)}
    docs = spark.createDataFrame([(k, "en", t) for k, t in texts.items()], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150)], "doc_id long, quality int, toxic int")
    found = {row["doc_id"]: row["keep"] for row in quality.scores(docs, labels).collect()}
    assert not any(found[k] for k in range(200, 220)) and sum(found[k] for k in range(150, 200)) >= 45
