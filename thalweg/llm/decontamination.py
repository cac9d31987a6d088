"""Benchmark decontamination by a broadcast hash set of normalised windows of words.

Texts are lower-cased (A-Z) and cut into words. A benchmark item's windows are its runs
of `window` consecutive words, or all its words where it has fewer. Their hashes are
broadcast; each document's window hashes are looked up and every find is verified
against the item's words. A document word inside any occurrence of a window is hit.

The benchmark is taken in blocks of at most BLOCK_WORDS words, each of them one
broadcast, and the documents pass by one block after the other, so no broadcast grows
with the benchmark. A single item longer than that is its own block.

Defined results: a null text has no words; a document without words is clean; items
without words or without an id are passed over; items that share an id count once;
repeated documents are judged each on its own.
"""

from __future__ import annotations

import re
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.tables import apart
from thalweg.session import discard, written

WINDOW = 13
#: A document is contaminated if it has hits and SHARE * hits >= words.
SHARE = 20
BLOCK_WORDS = 1_000_000

# Words are runs of what is none of these, once A-Z are lower case.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Windows:
    """The windows of a block of items, by their hash, for each length that occurs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        import numpy as np
        import xxhash

        self.items = items
        self.codes = {w: xxhash.xxh3_64_intdigest(w) | 1 for _, ws in items for w in ws}
        self.by_length: dict[int, tuple] = {}
        self.found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.powers()
        for k, (_, ws) in enumerate(items):
            n = min(window, len(ws))
            for i, h in enumerate(self.hashes(self.coded(ws), n)):
                self.found.setdefault((n, int(h)), []).append((k, i))
        for n in {n for n, _ in self.found}:
            self.by_length[n] = np.sort(np.array([h for m, h in self.found if m == n], "u8"))

    def powers(self, n: int = 4096) -> None:
        import numpy as np

        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, _BASE, "u8")]))
            self.down = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, _INVERSE, "u8")]))

    def coded(self, words: list[bytes]):
        """A code for each word, 0 for words that no item has."""
        import numpy as np

        return np.fromiter(map(self.codes.get, words, repeat(0)), "u8", len(words))

    def hashes(self, codes, n: int, at=None):
        """Hashes of the windows of n codes that begin at `at`, or of all."""
        import numpy as np

        while len(self.up) < len(codes) + 1:
            self.powers(2 * len(self.up))
        at = np.arange(len(codes) - n + 1) if at is None else at
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(codes * self.up[: len(codes)])])
            return (sums[at + n] - sums[at]) * self.down[at]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The verified spans of words that are windows, and the ids of their items."""
        import numpy as np

        codes = self.coded(words)
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        spans, ids = [], set()
        for n, known in self.by_length.items():
            if len(words) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = self.hashes(codes, n, at)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i, x in zip(at[known[place] == h].tolist(), h[known[place] == h].tolist(), strict=True):
                here = [k for k, j in self.found[n, x] if self.items[k][1][j : j + n] == words[i : i + n]]
                if here:
                    spans.append((i, i + n))
                    ids.update(self.items[k][0] for k in here)
        return spans, ids


def blocks(benchmark: DataFrame, window: int, most: int):
    """Windows of runs of items with at most so many words together."""
    items, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        words = words_of(bytes(text or b""))
        if not words or item_id is None:
            continue
        if items and size + len(words) > most:
            yield Windows(items, window)
            items, size = [], 0
        items.append((item_id, words))
        size += len(words)
    if items:
        yield Windows(items, window)


def _scanner(block, text_at: int):
    """Scans batches whose last three columns are the words, spans and items found so far."""

    def merged(spans: list[tuple[int, int]]) -> list[int]:
        flat: list[int] = []
        for a, b in sorted(spans):
            if flat and a <= flat[-1]:
                flat[-1] = max(flat[-1], b)
            else:
                flat += [a, b]
        return flat

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            n, spans, items = [], [], []
            texts = batch.column(text_at).cast(pa.binary())
            for text, own_spans, own_items in zip(texts, batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                words = words_of(text.as_py() or b"")
                new, ids = block.value.scan(words)
                n.append(len(words))
                if new:
                    own = own_spans.as_py()
                    spans.append(merged(new + list(zip(own[::2], own[1::2], strict=True))))
                    items.append(sorted(ids.union(own_items.as_py())))
                else:
                    spans.append(own_spans.as_py())
                    items.append(own_items.as_py())
            columns = batch.columns[:-3] + [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return scan


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (starts and ends of merged runs of words) and hit_items (sorted)."""
    new = ["n_words", "hit_spans", "hit_items"]
    found = docs.drop(*new).withColumns(dict(zip(new, (F.lit(0).cast("long"), F.array().cast("array<int>"), F.array().cast("array<string>")), strict=True)))
    start, text_at = found, found.columns.index("text")
    context, schema, sent = docs.sparkSession.sparkContext, found.schema, None
    for block in blocks(benchmark, window, block_words):
        if sent:  # only one block is held at a time
            before, found = found, written(found, "hits")
            discard(before)
            sent.destroy()
        sent = context.broadcast(block)
        found = found.mapInArrow(_scanner(sent, text_at), schema)
    return found if found is not start else found.mapInArrow(_scanner(context.broadcast(Windows([], window)), text_at), schema)


def n_hit() -> Column:
    """Hit words: ends less starts of hit_spans."""
    return F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(hits: Column, words: Column, share: int = SHARE) -> Column:
    return (hits > 0) & (share * hits >= words)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what find_hits returns."""
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256")).withColumn(
        "contaminated", contaminated(F.col("n_hit"), F.col("n_words"))
    )


def without_spans(text: bytes, spans: list[int]) -> bytes:
    """The text less its hit words and what stands between them."""
    words = list(_WORD.finditer(text))
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : words[a].start()])
        at = words[b - 1].end()
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, spans: bool = False) -> DataFrame:
    """The documents that stay, in docs' columns.

    Contaminated documents go; with spans, only hit words go, from every document.
    """
    docs, own = apart(docs, "doc_id", "text")
    found = find_hits(docs, benchmark, window)
    if not spans:
        return found.where(~contaminated(n_hit(), F.col("n_words"), share)).select(*own)
    return found.mapInArrow(_cleaner(docs.columns.index("text"), found.columns.index("hit_spans")), found.schema).select(*own)


def _cleaner(text_at: int, spans_at: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            pairs = zip(b.column(text_at).to_pylist(), b.column(spans_at).to_pylist(), strict=True)
            texts = [without_spans(t.encode(), spans).decode() if spans else t for t, spans in pairs]
            yield b.set_column(text_at, b.schema.field(text_at), pa.array(texts, b.schema.field(text_at).type))

    return run
