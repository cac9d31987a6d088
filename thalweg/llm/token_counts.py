"""Token counts of whole texts by the whole-token shortcut.

Offline, the vocabulary strings that form one pre-token and encode alone as one token
are proven with the tokenizer itself. A text is cut before every single space that a
non-space follows, where pre-tokens always end; each distinct piece is cut into
pre-tokens, of which the proven ones count one and only the rest are merged by the
tokenizer. Pieces repeat, so a bounded table of their counts serves most of a text.

Defined results: a null text counts as an empty one (no bytes, no tokens); a special
string inside a text is what the library makes of it by default; texts with white
space outside ASCII, where a cut could change pre-tokens, are encoded whole. Rows with
the same id, and columns of any other name, don't matter: there is one result a row.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Pieces whose counts a worker keeps; the table starts anew beyond this.
KEPT_PIECES = 400_000
#: Texts encoded or cut at once, so memory follows neither the input nor Arrow's batches.
SLICE_BYTES = 8_000_000

_OTHER_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_CUT = re.compile(rb" (?=[^\s])")
_LOOSE_SPACE = re.compile(rb" (?=\s|\Z)")


def new_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


tokenizer = functools.cache(new_tokenizer)


@functools.cache
def pre_tokens(pattern: str):
    import regex

    return regex.compile(pattern)


def whole_tokens(path: str, pattern: str) -> frozenset[str]:
    """The vocabulary strings proven to be one pre-token and, encoded alone, one token."""
    t, cut = tokenizer(path), pre_tokens(pattern)
    size = t.get_vocab_size(with_added_tokens=False)
    strings = [t.decode([i], skip_special_tokens=False) for i in range(size)]
    strings = [s for s in strings if s and "�" not in s and cut.findall(s) == [s]]
    return frozenset(s for s, e in zip(strings, t.encode_batch_fast(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class PieceCounts:
    """Counts of distinct pieces: those within a text, cut off with their space, and heads."""

    def __init__(self, path: str, pattern: str, whole: frozenset[str]):
        self.library, self.cut, self.whole = tokenizer(path), pre_tokens(pattern), whole
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, int] = {}
        self.same_cut: dict[str, bool] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, piece: str) -> bool:
        """Whether this module's pattern cuts the piece's characters as the library does."""
        for c in set(piece):
            if c not in self.same_cut:
                probe = f"a{c}1{c} {c}!{c}{c}"
                offsets = [o for _, o in self.library.pre_tokenizer.pre_tokenize_str(probe)]
                self.same_cut[c] = [probe[a:b] for a, b in offsets] == self.cut.findall(probe)
            if not self.same_cut[c]:
                return False
        return not any(s in piece for s in self.special)

    def learn(self, pieces: list[bytes]) -> None:
        counts, rest, at = [0] * len(pieces), [], []
        for k, raw in enumerate(pieces):
            piece = raw.decode()
            if piece in self.whole:
                counts[k] = 1
                continue
            for pre in self.cut.findall(piece) if self.plain(piece) else [piece]:
                if pre in self.whole:
                    counts[k] += 1
                else:
                    rest.append(pre)
                    at.append(k)
        for k, n in zip(at, self.encode(rest), strict=True):
            counts[k] += n
        self.known.update(zip(pieces, counts, strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        cuts, missing = [], set()
        for t in texts:
            if not t.isascii() and _OTHER_SPACE.search(t.decode()):
                cuts.append(None)
                continue
            head, *rest = _CUT.split(t) if _LOOSE_SPACE.search(t) else t.split(b" ")
            # within a table of pieces, the mark \xff, which UTF-8 never has, tells heads from the rest
            pieces = [b"\xff" + head, *rest] if head else rest
            cuts.append(pieces)
            missing.update(pieces)
        missing.difference_update(self.known)
        if len(self.known) + len(missing) > KEPT_PIECES:
            self.known = {}
            missing = set().union(*(c for c in cuts if c))
        if missing:
            marked = list(missing)
            before = len(self.known)
            self.learn_marked(marked)
            assert len(self.known) == before + len(marked)
        known = self.known.__getitem__
        return [self.encode([t.decode()])[0] if c is None else sum(map(known, c)) for t, c in zip(texts, cuts, strict=True)]

    def learn_marked(self, marked: list[bytes]) -> None:
        strings = [m[1:] if m[:1] == b"\xff" else b" " + m for m in marked]
        own, self.known = self.known, {}
        self.learn(list(dict.fromkeys(strings)))
        own.update((m, self.known[s]) for m, s in zip(marked, strings, strict=True))
        self.known = own


@functools.cache
def _counter(path: str, pattern: str, whole: frozenset[str]) -> PieceCounts:
    return PieceCounts(path, pattern, whole)


def slices(texts: list[bytes], most: int = SLICE_BYTES):
    """Runs of texts of so many bytes together, or a single longer one."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: its id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: a byte-level BPE of the tokenizers library; pattern: what cuts its pre-tokens.
    The proven strings, at most one for each entry of the vocabulary, are broadcast.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path, pattern))

    def count(batches):
        import pyarrow as pa

        counter = _counter(path, pattern, whole.value)
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            n = [k for run in slices(texts) for k in counter.count(run)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], [id_column, "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_column).cast("binary").alias("_text"))
    return rows.mapInArrow(count, f"`{id_column}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
