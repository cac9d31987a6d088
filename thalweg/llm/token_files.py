"""Token ids as Parquet list columns, for reading tokens or metadata alone.

Texts are dealt out by ranges of doc_id and sorted, then encoded where they lie. One
file a part holds doc_id, n_tokens, the start within the part and the list of ids;
ids are delta encoded (format version 2, no dictionary), row groups and pages have set
sizes, and the page indexes that Parquet's writer makes let a reader skip to the pages
of a range of doc_id. Offsets need the metadata columns only.

Defined results: a null or empty text holds the end id alone; rows with the same id
keep their own lists, ordered by a hash of the text; extra columns are left out of the files.
"""

from __future__ import annotations

import functools
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.session import shared_dir, shuffles_removed
from thalweg.llm.tables import runs_of_texts
from thalweg.llm.token_counts import new_tokenizer, tokenizer

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Runs of marks, or words of other forms, and runs of letters whose ids a worker keeps, besides those of a slice; of more, those asked for last stay.
KEPT_WORDS = 200_000
KEPT_LETTERS = 400_000
#: Words that are encoded at once.
RUN_WORDS = 500
#: What the vocabulary's last token of a word ends with (fixed value).
WORD_END = "</w>"
SLICE_BYTES = 4_000_000
#: Bytes of text in a file.
PART_BYTES = 32 << 20
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"
#: Bytes of a row group and of a page, and the encodings, as Parquet's writer takes them.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.page.write-checksum.enabled": "true",
    "compression": "snappy",
}

_LETTERS = re.compile(rb"([a-zA-Z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


class _Recent:
    """A bounded table by words: once half of it has come anew, what wasn't asked for since then goes."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def missing(self, words) -> list[bytes]:
        """Those of distinct words that are to be put into `young`, which holds the others then."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        young, old, found = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old.pop(w)
                else:
                    found.append(w)
        return found


class WordIds:
    """The ids of white-space separated words, as little-endian 32-bit integers.

    The vocabulary drops white space and lower-cases, so a text's ids are those of its
    words one after the other, and those of a run of letters and the marks after it are
    those of the letters, then those of the marks. Letters are characters that the
    library, after its own normalising, keeps together with a letter and apart from a
    mark; a word whose letters normalise to anything else is encoded whole.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import normalizers, pre_tokenizers

        self.library, self.plain = tokenizer(path), new_tokenizer(path)
        # lower-case ASCII letters are what the library's normaliser and cutting leave as they are
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.letters, self.rest = _Recent(KEPT_LETTERS), _Recent(KEPT_WORDS)
        self.alphabet: dict[str, bool] = {}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def one_by_one(self, words: list[bytes]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def runs(self, words: list[bytes], library) -> list[bytes]:
        """Ids of words of letters alone: each is one pre-token, whose last id ends a word."""
        import numpy as np

        ids = np.array(library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words):
            return self.one_by_one(words)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def is_letter(self, c: str) -> bool:
        if c not in self.alphabet:
            probe = f"a{c}!"
            self.alphabet[c] = [probe[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe)] == [f"a{c}", "!"]
        return self.alphabet[c]

    def of_letters(self, cores: list[bytes]) -> list[bool]:
        """Whether the library's normalising leaves letters alone."""
        normalise = self.library.normalizer.normalize_str
        found = normalise(b" ".join(cores).decode()).split(" ")
        if len(found) != len(cores):  # white space among the cores
            found = [normalise(c.decode()) for c in cores]
        other = {c for c in set().union(*found) if not self.is_letter(c)}
        return [bool(f) and other.isdisjoint(f) for f in found]

    def learn(self, cores: list[bytes]) -> dict[bytes, bytes | None]:
        """A table that holds the ids of distinct runs of letters, in lower case if of ASCII; none for those that normalising alters."""
        letters, new = self.letters, self.letters.missing(cores)
        plain, other = [c for c in new if c.isascii()], [c for c in new if not c.isascii()]
        pure = dict(zip(other, self.of_letters(other), strict=True)) if other else {}
        letters.young.update((c, None) for c in other if not pure[c])
        for own, library in ((plain, self.plain), ([c for c in other if pure[c]], self.library)):
            for k in range(0, len(own), RUN_WORDS):
                letters.young.update(zip(own[k : k + RUN_WORDS], self.runs(own[k : k + RUN_WORDS], library), strict=True))
        return letters.young

    def distinct(self, words) -> list[bytes]:
        """Ids of each of an Arrow column of distinct words."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        as_list = lambda column: column.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        cores = pc.ascii_rtrim(words, characters=_MARKS)
        ascii_only = pc.ascii_is_alpha(cores)
        coded = pc.ascii_lower(pc.if_else(ascii_only, cores, "")).dictionary_encode()
        lower = as_list(coded.dictionary)
        other = np.flatnonzero(~ascii_only.to_numpy(zero_copy_only=False))
        more = list(zip(other.tolist(), as_list(words.take(pa.array(other))), strict=True))
        more = [(k, w, (_LETTERS.fullmatch(w) or (None, b"", w))) for k, w in more]
        more = [(k, w, m[1].lower(), m[2]) for k, w, m in more]
        known = self.learn(list({*lower, *(core for _, _, core, _ in more)} - {b""}))
        of_core = [known[core] if core else b"" for core in lower]
        found = list(map(of_core.__getitem__, coded.indices.to_numpy().tolist()))
        sizes = pc.binary_length(cores).to_numpy()
        marked = np.flatnonzero((pc.binary_length(words).to_numpy() > sizes) & ascii_only.to_numpy(zero_copy_only=False))
        tails = [(k, w[n:]) for k, w, n in zip(marked.tolist(), as_list(words.take(pa.array(marked))), sizes[marked].tolist(), strict=True)]
        for k, w, core, tail in more:
            if core and known[core] is not None:
                found[k] = known[core]
                tails.append((k, tail))
            else:
                tails.append((k, w))
        missing = self.rest.missing({tail for _, tail in tails} - {b""})
        for k in range(0, len(missing), RUN_WORDS):
            self.rest.young.update(zip(missing[k : k + RUN_WORDS], self.one_by_one(missing[k : k + RUN_WORDS]), strict=True))
        for k, tail in tails:
            if tail:
                found[k] += self.rest.young[tail]
        return found

    def flat(self, texts):
        """(ids of an Arrow column of texts one after the other, the places where each text begins and the last ends)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # Arrow cuts at the same characters as bytes.split(), but makes empty words before and after them
        words = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
        coded = words.flatten().dictionary_encode()
        found = self.distinct(coded.dictionary)
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), "i4", len(found)) // 4
        at = coded.indices.to_numpy()
        counts = sizes[at]
        before = np.concatenate([[0], np.cumsum(counts)]).astype("i4")
        # of each id, its place among those of distinct words
        places = np.repeat((np.cumsum(sizes, dtype="i4") - sizes)[at] - before[:-1], counts)
        places += np.arange(before[-1], dtype="i4")
        ends = words.offsets.to_numpy()
        return ids[places], before[ends - ends[0]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        import pyarrow as pa

        ids, ends = self.flat(pa.array(texts, pa.binary()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def write_tokens(docs: DataFrame, vocabulary_path: str, folder: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) and write their ids to folder in ascending doc_id order."""
    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, part, start = _word_ids(vocabulary_path), TaskContext.get().partitionId(), 0
        for b in batches:
            for at, n in runs_of_texts(b.column(1), SLICE_BYTES):
                found, ends = words.flat(b.column(1).slice(at, n))
                flat = np.insert(found, ends[1:], end_id)
                ends = ends + np.arange(n + 1)
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view("<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(np.full(n, part, "i4")), pa.array(start + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()), tokens], ["doc_id", "part", "part_start", "n_tokens", "tokens"])
                start += int(ends[-1])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))), -(-size // PART_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "tie")
    with shuffles_removed(docs.sparkSession):
        rows.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(folder)


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    """part and the number of ids before it: one row a file, from the metadata columns alone."""
    ends = spark.read.schema(SCHEMA).parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    rows, before = [], 0
    for part, n in sorted(ends.collect()):
        rows.append((part, before))
        before += n
    return spark.createDataFrame(rows, "part int, before long")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens, from the files."""
    return (
        spark.read.schema(SCHEMA)
        .parquet(folder)
        .join(F.broadcast(offsets(spark, folder)), "part")
        .select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "tokens")
    )


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, and the crc32 of the ids as little-endian 32-bit integers."""

    def digest(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            lists = b.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/thalweg/{uuid.uuid4().hex}/tokens"
