from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, n string, words string, size string, id string, part string, bucket string"
EXTRA = ("x", "y", "z", "w", "v", "u", "t")


@pytest.fixture(scope="session")
def odd_docs():
    """doc_id -> (text, lang, source): nulls, empty and long texts, ties, copies, near copies."""
    r = random.Random(5)
    words = ["water", "runs", "down", "the", "Hill", "stone", "and", "river", "über", "naïve", "水", "3.14", "it's", "THE", "😀", "é"]
    prose = lambda n: " ".join(r.choices(words, k=n))
    base = prose(60)
    texts = [None, "", " \t\n ", "one", "one two", base, base, base.upper(), base + " tail", base.replace("river", "lake", 1), prose(3000), prose(3), "a  b\tc\n\nd", "<|endoftext|> x", "tail space ", "é nbsp sep", "\x00nul \x1fus"]
    texts += [prose(40) for _ in range(12)] + ["same line here for all of us\n" + prose(12) + "\nSame  line here for all of us\n\nlast" for _ in range(4)]
    texts += [f"{base} {k}" for k in range(12)]
    sources = ["b", "a", None, "é"]
    return {i + 3 * (i % 2): (t, ["en", "de", None][i % 3], sources[0] if i % 3 == 0 else sources[i % 4]) for i, t in enumerate(texts)}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *EXTRA) for i, (t, lang, source) in docs.items()], SCHEMA)


@pytest.fixture
def docs(spark, odd_docs):
    return frame(spark, odd_docs).repartition(3)


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
