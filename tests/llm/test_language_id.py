"""Language identification: paths against a plain search, held-out accuracy, spans of mixed texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from thalweg.llm import language_id, queries
from thalweg.llm.language_id import SWITCH, best_paths, grams_of, label_words, words_of

SCHEMA = "doc_id long, text string, lang string, n string, bucket string, score string"
SYLLABLES = {"aa": "ba ko mi tu ra ne lo si".split(), "bb": "sch wer ung ein ich dro fel".split(), "el": "και το της με για δεν".split(), "ru": "не на что это как по".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 4))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    made = [(k, prose(r, lang, r.choice([3, 20, 300])), lang) for k in range(160) for lang in [list(SYLLABLES)[k % 4]]]
    return made + [(900, None, "aa"), (901, "", "bb"), (902, "12 ² _ 34 !", "aa"), (903, prose(r, "ru", 30), None), (903, prose(r, "el", 30), None), (None, prose(r, "bb", 30), None)]


@pytest.fixture(scope="module")
def model(spark, rows):
    return language_id.fit(frame(spark, rows))


def plain_path(scores, prior):
    value, back = list(prior), []
    for s in scores:
        top = max(range(len(value)), key=lambda k: (value[k], -k))
        came = [k if value[k] >= value[top] - SWITCH else top for k in range(len(value))]
        value = [max(value[k], value[top] - SWITCH) + s[k] for k in range(len(value))]
        back.append(came)
    at, path = max(range(len(value)), key=lambda k: (value[k], -k)), []
    for came in reversed(back):
        path.append(at)
        at = came[at]
    return path[::-1]


def test_paths_equal_a_plain_search():
    r = np.random.default_rng(2)
    scores = -r.integers(0, 9, (50, 3)).astype("f4")
    sizes = [0, 1, 7, 40, 3, 40, 0]
    words = r.integers(0, 50, sum(sizes))
    ends = np.cumsum(sizes)
    found = best_paths(scores, words, ends - sizes, ends, [0.0, -1.0, -2.0])
    for path, a, b in zip(found, ends - sizes, ends, strict=True):
        assert path.tolist() == plain_path(scores[words[a:b]].tolist(), [0.0, -1.0, -2.0])[: b - a]


def test_counts_equal_plain_ones(spark):
    texts = ["Ab ab é", "水が ab"]
    found = {(x["lang"], x["bucket"]): x["n"] for x in language_id.gram_counts(frame(spark, [(1, texts[0], "x"), (2, texts[1], "y"), (3, texts[0], None)]), 1 << 10).collect()}
    for lang, text in zip("xy", texts, strict=True):
        runs = [x for w in words_of(text) for x in grams_of([w], 1 << 10)[0].tolist()]
        assert {b: n for (of, b), n in found.items() if of == lang and b >= 0} == {b: runs.count(b) for b in set(runs)}
    # a run for each of 1 to 4 characters that begins in the word or before it
    assert len(grams_of(["ab"], 1 << 10)[0]) == 2 + 3 + 2 + 1


def test_predictions(spark, rows, model):
    found = {(x["doc_id"], x["lang_pred"]): x["score"] for x in language_id.predict(frame(spark, rows).repartition(3), model).collect()}
    assert len(found) == len(rows)
    for k, _, lang in rows[:160]:
        assert found[k, lang] > 0.9
    assert found[900, "und"] == found[901, "und"] == found[902, "und"] == 0
    assert {(903, "ru"), (903, "el"), (None, "bb")} <= set(found)


def test_spans_of_mixed_texts(spark, model, monkeypatch):
    r = random.Random(9)
    parts = [prose(r, lang, 25) for lang in ("aa", "bb", "aa", "el", "ru")]
    text = "  ".join(parts) + " 77."
    rows = [(1, text, None), (2, "!!", None), (3, None, None), (4, "word " * 3 + "x" * 1000, None)]
    found = [tuple(x) for x in language_id.spans(frame(spark, rows), model).collect()]
    mixed = [x for x in found if x[0] == 1]
    assert [x[3] for x in mixed] == ["aa", "bb", "aa", "el", "ru"]
    at = 0
    for (_, a, b, _), part in zip(mixed, parts, strict=True):
        assert abs(a - at) <= 12 and abs(b - at - len(part)) <= 12
        at += len(part) + 2
    assert {x[0] for x in found} == {1, 4} and max(x[2] for x in found if x[0] == 4) == 1015
    whole = label_words([text * 40], model)[1]
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert (label_words([text * 40], model)[1] == whole).all()


def test_words_of_unknown_scripts_take_their_surroundings(spark, model):
    r = random.Random(1)
    rows = [(1, prose(r, "bb", 9) + " ไทย " + prose(r, "bb", 9), None), (2, "ไทย ภาษา", None)]
    found = {x["doc_id"]: x for x in language_id.predict(frame(spark, rows), model).collect()}
    assert found[1]["lang_pred"] == "bb" and found[1]["score"] == 1 and found[2]["lang_pred"] in SYLLABLES


def test_nothing_learned_and_no_rows(spark, rows):
    for given in (rows[:0], [(1, "text", None)], [(1, None, "aa"), (2, "5", "bb")]):
        nothing = language_id.fit(frame(spark, given))
        assert nothing.languages == []
        assert {(x["lang_pred"], x["score"]) for x in language_id.predict(frame(spark, rows), nothing).collect()} == {("und", 0.0)}
        assert language_id.spans(frame(spark, rows), nothing).count() == 0
    assert language_id.predictions(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        language_id.buckets_for(language_id.MOST_LANGUAGES + 1)


def test_held_out_accuracy(spark, sf_dir):
    found = {x["doc_id"]: x for x in queries.op13_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(docs)
    judged = [found[d]["lang_pred"] == lang for d, lang in docs if found[d]["held_out"] and lang]
    assert all(x["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= x["score"] <= 1 for d, x in found.items())
    assert len(judged) > 30 and np.mean(judged) > 0.95
