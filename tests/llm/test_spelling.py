"""Spelling variants against all pairs of a plain version."""

from __future__ import annotations

import random
import zlib
from collections import Counter

from thalweg.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in spelling.RUNS.findall((text or "").translate(spelling.SMALL)):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    form, near = {}, {}
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if one_apart(w, x))
        near[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
    found = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return found


def hard_rows():
    r = random.Random(11)
    stems = ["stone", "aaaaa", "àÀéèß", "banana", "letter", "ababab", "zzzzzzzzzzzz", "x" * 300]
    words = list(stems)
    for _ in range(500):
        w = r.choice([x for x in words if len(x) > 4])
        k = r.randrange(len(w))
        words.append(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abtàz") + w[k:], w[:k] + r.choice("abtàz") + w[k + 1 :]]))
    rows = [(i, " ".join(r.choices(words, weights=[1 + 400 // (1 + k) for k in range(len(words))], k=300))) for i in range(60)]
    rows += [(1, "Stone STONE\tstone, stone! ÷×÷×÷ ÷×÷×÷ 水stone_stone9stone"), (1, "Stone STONE"), (None, "stone " * 200), (None, None), (5, ""), (6, "  \n")]
    return rows + [(900 + k, "q" * 100_000) for k in range(3)] + [(910 + k, "q" * 99_999) for k in range(9)]


def test_variants_equal_all_pairs(spark):
    rows = hard_rows()
    words = plain_words(rows)
    found = {tuple(r) for r in spelling.variants(spelling.vocabulary(frame(spark, rows).repartition(3))).collect()}
    assert len(words) > 200 and {len(w) for w in words} > {99_999, 100_000}
    assert found == plain_variants(words)
    assert max(x[4] for x in found) > 4 and any(x[1] and x[1] != x[2] for x in found)


def test_long_texts_are_cut_between_runs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    text = " ".join(f"word{'abcdefgh'[k % 8] * (k % 5)}" for k in range(400))
    for most in (1, 7, 50):
        assert "".join(spelling.slices(text, most)) == text
        assert [x for p in spelling.slices(text, most) for x in spelling.RUNS.findall(p)] == spelling.RUNS.findall(text)
    rows = [(3, text), (4, text)]
    assert {(r["word"], r["n"]) for r in spelling.vocabulary(frame(spark, rows)).collect()} == set(plain_words(rows).items())


def test_words_as_they_are_written(spark):
    rows = [(k, "weather wether weather") for k in range(97 * 3)]
    found = {r["word"]: (r["form"], r["n"]) for r in spelling.variants(spelling.vocabulary(frame(spark, rows), misspell=False)).collect()}
    assert found == {"weather": (None, 2 * 291), "wether": ("weather", 291)}


def test_empty(spark):
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).count() == 0
    assert spelling.variants(spelling.vocabulary(frame(spark, [(1, "few"), (2, None)]))).count() == 0
