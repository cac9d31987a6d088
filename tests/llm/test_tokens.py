"""Token counts and token files against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from thalweg.llm import token_counts, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("word_bpe_49k.json"))


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(docs, odd_docs):
    found = {r["doc_id"]: r for r in token_counts.token_counts(docs, BYTES, public_tokenizers.PATTERN, limit=40).collect()}
    for (i, (text, _, _)), ids in zip(odd_docs.items(), library(BYTES, [t for t, _, _ in odd_docs.values()]), strict=True):
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((text or "").encode()), len(ids), len(ids) > 40)


def test_counts_on_the_drivers_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = dict(token_counts.token_counts(docs, BYTES, public_tokenizers.PATTERN).select("doc_id", "n_tokens").collect())
    assert found == dict(zip(texts, map(len, library(BYTES, texts.values())), strict=True))


def test_proven_strings_are_single_tokens():
    whole = token_counts.whole_tokens(BYTES, public_tokenizers.PATTERN)
    assert len(whole) > 30_000 and all(len(ids) == 1 for ids in library(BYTES, sorted(whole)[::97]))


def test_kept_tables_are_bounded(docs, odd_docs, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_PIECES", 5)
    counter = token_counts.PieceCounts(BYTES, public_tokenizers.PATTERN, token_counts.whole_tokens(BYTES, public_tokenizers.PATTERN))
    texts = [t or "" for t, _, _ in odd_docs.values()]
    assert [counter.count([t.encode()])[0] for t in texts] == list(map(len, library(BYTES, texts)))


#: Characters that normalising, lower case or cutting treats in ways of its own.
ODD = list("İǅﬁªßΣςŞÅé水한글ัา٣²Ⅷ😀") + ["e\u0301", "\u0307", "\u0338", "\u200d", "\xa0", "\u2028", "\u3000", "\x85", "\x1c", "\x00", "\ufeff", "'s", "'", "<|endoftext|>", "<|startoftext|>"]


def hostile(n: int) -> list[str]:
    r = random.Random(11)
    plain = list("abAZ09.,!?-_()\"' \t\n")
    return ["".join(r.choices(ODD + plain, k=r.randint(0, 24))) for _ in range(n)]


def test_hostile_words_have_the_librarys_ids():
    texts = ["ŞEHRİ, ve", "İKİ.", "DİKKATİ!", "oﬁ!", *hostile(20_000)]
    words = token_files.WordIds(WORDS)
    found = [i for k in range(0, len(texts), 500) for i in words.encode([t.encode() for t in texts[k : k + 500]])]
    wanted = [np.array(ids, "<u4").tobytes() for ids in library(WORDS, texts)]
    assert [t for t, a, b in zip(texts, found, wanted, strict=True) if a != b] == []


def test_tables_of_words_are_bounded(monkeypatch):
    for name in ("KEPT_WORDS", "KEPT_LETTERS", "RUN_WORDS"):
        monkeypatch.setattr(token_files, name, 7)
    words = token_files.WordIds(WORDS)
    texts = hostile(300)
    assert [words.encode([t.encode()])[0] for t in texts] == [np.array(ids, "<u4").tobytes() for ids in library(WORDS, texts)]


def test_repeated_and_null_ids_keep_their_rows(spark):
    texts = [(None, "a b c"), (3, "one two"), (3, "one two"), (3, "two one three"), (None, None), (1, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    rows = token_files.token_digests(token_files.read_tokens(spark, _stored(spark, docs))).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((str(i), len(ids) + 1) for (i, _), ids in zip(texts, library(WORDS, [t for _, t in texts]), strict=True))
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    counted = token_counts.token_counts(docs, BYTES, public_tokenizers.PATTERN).collect()
    assert sorted(r["n_tokens"] for r in counted) == sorted(map(len, library(BYTES, [t for _, t in texts])))


def test_texts_beyond_a_slice(spark, monkeypatch):
    """Slices hold runs of texts, or one longer text, whose ids and counts are the library's."""
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 50)
    texts = [" ".join(["river İ, stone"] * 40), "a", "b c", "d" * 60, ""]
    raw = [t.encode() for t in texts]
    runs = list(token_counts.slices(raw, 50))
    assert [t for r in runs for t in r] == raw and len(runs) == 4
    words = token_files.WordIds(WORDS)
    assert [x for r in runs for x in words.encode(r)] == [np.array(ids, "<u4").tobytes() for ids in library(WORDS, texts)]


def _wanted(docs: dict[int, str | None]):
    start = 0
    for i, ids in zip(sorted(docs), library(WORDS, [docs[i] for i in sorted(docs)]), strict=True):
        ids = [*ids, token_files.END_ID]
        yield i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        start += len(ids)


def _stored(spark, docs):
    folder = token_files.new_folder(spark)
    token_files.write_tokens(docs, WORDS, folder)
    return folder


def test_files_round_trip(spark, docs, odd_docs):
    tokens = token_files.read_tokens(spark, _stored(spark, docs))
    wanted = list(_wanted({i: t for i, (t, _, _) in odd_docs.items()}))
    assert sorted(map(tuple, token_files.token_digests(tokens).collect())) == [w[:4] for w in wanted]
    assert {r["doc_id"]: r["tokens"] for r in tokens.collect()} == {w[0]: w[4] for w in wanted}


def test_files_of_the_drivers_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sorted(map(tuple, token_files.token_digests(token_files.read_tokens(spark, _stored(spark, docs))).collect()))
    assert found == [w[:4] for w in _wanted({r["doc_id"]: r["text"] for r in docs.collect()})]


def test_files_have_page_indexes_and_delta_encoding(spark, docs):
    import glob

    import pyarrow.parquet as pq

    folder = _stored(spark, docs).removeprefix("file://")
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(4) for f in glob.glob(f"{folder}/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert all("DELTA_BINARY_PACKED" in c.encodings and c.has_column_index and c.has_offset_index for c in columns)


def test_offsets_read_no_tokens(spark, docs):
    folder = _stored(spark, docs)
    plan = spark.read.schema(token_files.SCHEMA).parquet(folder).groupBy("part").sum("n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("Physical Plan")[1]


def test_empty_tables(spark, no_docs):
    assert token_counts.token_counts(no_docs, BYTES, public_tokenizers.PATTERN).count() == 0
    assert token_files.read_tokens(spark, _stored(spark, no_docs)).count() == 0


def test_words_are_learnt_once(monkeypatch):
    """What comes again stays in the worker's tables, however many words come once only."""
    monkeypatch.setattr(token_files, "KEPT_LETTERS", 40)
    words, learnt = token_files.WordIds(WORDS), []
    runs = words.runs
    monkeypatch.setattr(words, "runs", lambda cores, library: learnt.extend(cores) or runs(cores, library))
    once = ["x" + "abcdefghij"[k // 10] + "abcdefghij"[k % 10] for k in range(100)]
    texts = [f"River, stone {a} {b}! RIVER; don't éclair" for a, b in zip(once[::2], once[1::2], strict=True)]
    assert [words.encode([t.encode()])[0] for t in texts] == [np.array(ids, "<u4").tobytes() for ids in library(WORDS, texts)]
    assert sorted(learnt) == sorted([*(w.encode() for w in once), b"river", b"stone", "éclair".encode()])
    assert len(words.letters.young) + len(words.letters.old) <= 50
