"""Spelling variants of a corpus's words by wildcard groups, without pairs.

Words are counted over whole texts, and those that are long and frequent enough make up
a vocabulary. Two words are near if they differ by one character that is replaced,
inserted or deleted. A word with a gap in place of one character, as (place, prefix,
suffix), is a key: words that fill the gap differ by a replacement, and the word that is
just prefix and suffix differs from each of them by an insertion. That word is placed
under the keys of all its gaps; of a run of equal characters, which give the same word
when deleted, only the first stands for the deletion. So each pair of near words meets
under one key, and a key keeps only its size and its two most frequent words, which
answer for every member: the most frequent of the others, and how many these are.

Prefixes and suffixes are 64-bit hashes (two words that agree in all else share a key
wrongly once in 2^64), so a key is of one size and a word of n characters has 2n + 1 of
them; a key has at most as many members as the alphabet has characters, and one. Words are known by their ranks in code-point order, which
break ties.

Defined results: null texts have no words; a null id counts as the word null; rows that
repeat an id count each on its own; a word without near ones has no form and is its own
root. Columns of other names don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.tables import in_order
from thalweg.session import discard, written

#: Letters that words are made of, and the capitals that are made small.
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One run in so many loses a character, to make misspellings.
MISSPELT = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is so many times as frequent as the word.
FORM_SHARE = 2
#: Characters of a text that are cut into runs at once.
SLICE = 2_000_000
#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Characters of words whose keys are made at once.
KEYED = 200_000
_KEYS = "place int, size int, prefix long, suffix long, kind byte, rank long, n long"
#: What a row is to its key: a word that fills the gap and stands for the deletion, one that fills it only, the word without it.
_FIRST, _FILLED, _BARE = 0, 1, 2


def misspelt(run: str, doc_id: str) -> str:
    """run less one character, if its checksum with the id says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def slices(text: str, most: int = SLICE):
    """text in slices of about so many characters, cut where no run is."""
    a = 0
    while len(text) - a > most:
        b = a + most
        while b < len(text) and RUNS.match(text[b]):
            b += 1
        yield text[a:b]
        a = b
    yield text[a:] if a else text


def occurrences(docs: DataFrame, misspell: bool = True) -> DataFrame:
    """word, n: counts of the words of docs (doc_id, text), some misspelt."""

    def count(batches):
        import pyarrow as pa

        found: Counter[str] = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                key = doc_id.as_py() if doc_id.is_valid else "null"
                begun = zlib.crc32(f"{key}:".encode())
                for part in slices(text.as_py() or ""):
                    for run, n in Counter(RUNS.findall(part.translate(SMALL))).items():
                        if misspell and not zlib.crc32(run.encode(), begun) % MISSPELT:
                            run = misspelt(run, key)
                        if len(run) >= LEAST_LENGTH:
                            found[run] += n
                    if len(found) > HELD:
                        yield table()
                        found.clear()
        if found:
            yield table()

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, misspell: bool = True) -> DataFrame:
    """word, n of the words of at least LEAST_COUNT occurrences."""
    return occurrences(docs, misspell).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def mixed(x):
    """64-bit numbers with their bits spread, in place of x."""
    import numpy as np

    # Constants of a well-known finaliser.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def beginnings(letters):
    """Hashes of the 0, 1, ... first characters of words of one length (rows of code points)."""
    import numpy as np

    found = np.zeros((letters.shape[1] + 1, len(letters)), "u8")
    for k in range(letters.shape[1]):
        found[k + 1] = mixed(found[k] * np.uint64(0x9E3779B97F4A7C15) + letters[:, k] + np.uint64(1))
    return found


def keys_of(words: list[str], ranks, counts):
    """Columns of _KEYS for words of one length."""
    import numpy as np

    size = len(words[0])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size).astype("u8")
    ahead, behind = beginnings(letters), beginnings(letters[:, ::-1])[::-1]  # of the characters before and from a place on
    run = np.ones((size, len(words)), bool)
    run[1:] = (letters[:, 1:] != letters[:, :-1]).T
    place = np.concatenate([np.repeat(np.arange(size), len(words)), np.repeat(np.arange(size + 1), len(words))])
    return (
        place.astype("i4"),
        np.repeat([size - 1, size], [size * len(words), (size + 1) * len(words)]).astype("i4"),
        np.concatenate([ahead[:-1].ravel(), ahead.ravel()]).view("i8"),
        np.concatenate([behind[1:].ravel(), behind.ravel()]).view("i8"),
        np.concatenate([np.where(run, _FIRST, _FILLED).ravel(), np.full((size + 1) * len(words), _BARE)]).astype("i1"),
        np.tile(ranks, 2 * size + 1),
        np.tile(counts, 2 * size + 1),
    )


def gap_keys(words: DataFrame) -> DataFrame:
    """A row of _KEYS for each gap of words (word, rank, n); size is that of prefix and suffix."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = [c.split()[0] for c in _KEYS.split(", ")]
        for b in batches:
            texts, ranks, counts = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            lengths = np.array([len(t) for t in texts], "i8")
            order = np.argsort(lengths, kind="stable")
            for size in np.unique(lengths):
                same = order[np.searchsorted(lengths[order], size) : np.searchsorted(lengths[order], size, "right")]
                step = max(1, KEYED // int(size))
                for a in range(0, len(same), step):
                    some = same[a : a + step]
                    columns = keys_of([texts[k] for k in some], ranks[some], counts[some])
                    # a long word's keys go on piece by piece
                    for at in range(0, len(columns[0]), 4 * KEYED):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 4 * KEYED]) for c in columns], names)

    return words.select("word", "rank", "n").mapInArrow(run, _KEYS)


def near_words(words: DataFrame) -> DataFrame:
    """rank, n_near, best_n, best (rank): how many words are near each of words (word, rank, n) that has any, and the most frequent, the first on ties."""
    keys = ("place", "size", "prefix", "suffix")
    # a key's members are as many as the alphabet's characters at most
    groups = gap_keys(words).groupBy(*keys).agg(F.collect_list(F.struct("kind", F.col("n"), F.col("rank"))).alias("members")).where(F.size("members") > 1)
    order = lambda test: F.slice(F.array_sort(F.transform(F.filter("members", test), lambda x: F.struct((-x["n"]).alias("less"), x["rank"].alias("rank")))), 1, 2)
    count = lambda test: F.size(F.filter("members", test))
    filled, first, bare = (lambda x: x["kind"] != _BARE), (lambda x: x["kind"] == _FIRST), (lambda x: x["kind"] == _BARE)
    kept = groups.select("members", count(filled).alias("n_filled"), count(first).alias("n_first"), order(filled).alias("filled"), order(first).alias("first"), order(bare).alias("bare"))
    each = kept.select(F.explode("members").alias("m"), "n_filled", "n_first", "filled", "first", "bare").select("m.*", "n_filled", "n_first", "filled", "first", "bare")
    other = F.filter("filled", lambda x: x["rank"] != F.col("rank"))
    is_bare, stands = F.col("kind") == _BARE, F.col("kind") == _FIRST
    nothing = F.slice("bare", 1, 0)
    met = F.when(is_bare, F.slice("first", 1, 1)).otherwise(F.concat(other, F.when(stands, F.col("bare")).otherwise(nothing)))
    n_met = F.when(is_bare, F.col("n_first")).otherwise(F.col("n_filled") - 1 + F.when(stands, F.size("bare")).otherwise(0))
    found = each.select("rank", n_met.cast("long").alias("met"), F.array_min(met).alias("best")).where("met > 0")
    best = found.groupBy("rank").agg(F.sum("met").alias("n_near"), F.min("best.less").alias("less"), F.min(F.struct("best.less", "best.rank")).alias("best"))
    return best.select("rank", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.rank").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """rank, root: the last of the forms (rank, form) that lead on from each word that has one.

    Forms grow in frequency, so they run in no cycle, and no further than the doublings of the largest count.
    """
    table, k = written(forms.select("rank", F.col("form").alias("root")), "roots"), 0
    while True:
        state, k = table.select("rank", "root"), k + 1
        ahead = state.select(F.col("rank").alias("root"), F.col("root").alias("_next"))
        step = state.join(ahead, "root", "left").select("rank", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        before, table = table, written(step, f"roots-{k}")
        discard(before)
        if not table.where("moved").take(1):
            return table.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    ranked = written(in_order(words, "word").withColumnRenamed("position", "rank"), "words")
    near = written(near_words(ranked), "near")
    forms = written(near.join(ranked.select("rank", "n"), "rank").where(F.col("best_n") >= FORM_SHARE * F.col("n")).select("rank", F.col("best").alias("form"), F.col("best_n").alias("form_n")), "forms")
    last = roots(forms)
    name = lambda c: ranked.select(F.col("rank").alias(c), F.col("word").alias(f"{c}_word"))
    named = forms.join(last, "rank").join(name("form"), "form").join(name("root"), "root").select("rank", "form_word", "root_word", "form_n")
    found = ranked.join(near.select("rank", "n_near"), "rank", "left").join(named, "rank", "left")
    return found.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
