"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

A document's set holds the hashes of its runs of `width` words. One permutation hashes
each shingle once: the hash picks a bin, and each bin keeps its least hash; an empty bin
borrows from the bin that a universal hash of (bin, attempt) names, until that is a full
one (optimal densification). Bands of bins make bucket keys. Documents with equal sets
are one class from here on, so copies never meet in pairs.

In a bucket, candidates are stars (see stars.py): no link of a bucket is given up, though
most pairs are never made. Two filters go along with a member. Parities: each shingle
flips one of PARITIES bits, so sets differ in at least as many shingles as bits; this
loses nothing, and tells small sets apart. Two bits of each bin, for large sets, if
`sigmas` is given: a pair whose bits differ in more bins than so many deviations above
what the similarity asks for is no candidate, which refuses some links (3 in 10^6 at
4.5). Links are confirmed on the full sets.

Defined results: lower-casing is that of A-Z; a document with fewer words than `width`
has all of them as its one shingle; a null or wordless text has an empty set and is
linked with nothing; rows that repeat an id are one node, linked by any of their texts;
rows without an id are left out of links and are their own groups. Ids may be of any
type with an order, and keep it: the smallest string is the first in code points. Columns
of docs other than doc_id and text are never looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.stars import star_links
from thalweg.llm.tables import text_runs, with_ids
from thalweg.session import written

WIDTH = 5
SIMILARITY = (80, 100)
#: Bands and bins of a band. At a similarity of 0.8 a pair shares no bucket once in 10^4.
BANDS = 24
ROWS = 5
#: Standard deviations of the number of unequal bins that a candidate may have beyond the expected (links refused: 3 in 10^6); None asks for no such filter, and no link is refused.
SIGMAS: float | None = 4.5
#: Bits that shingles flip: a multiple of 64.
PARITIES = 512
#: Words whose hashes a worker keeps; the table starts anew beyond this.
KEPT_WORDS = 200_000
#: Bytes of texts whose sets a worker holds at once.
SLICE_BYTES = 2_000_000
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x):
    """A bijective mixing of 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def shingles(text: bytes, width: int):
    """The sorted distinct shingle hashes of a text."""
    import numpy as np

    words = text.lower().split()  # of bytes: A-Z, and the white space of ASCII
    h = np.fromiter(map(_words.__getitem__, words), "u8", len(words))
    n = max(1, len(h) - width + 1) if len(h) else 0
    total = np.full(n, min(width, len(h)), "u8")
    for k in range(min(width, len(h))):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(total)


def donors(bins: int, attempts: int = 64):
    """The bins that an empty bin asks, attempt by attempt; the same for all documents."""
    import numpy as np

    grid = np.arange(bins, dtype="u8")[:, None] * np.uint64(1 << 20) + np.arange(1, attempts + 1, dtype="u8")
    return (mixed(grid + np.uint64(0x632BE59BD9B4E019)) % np.uint64(bins)).astype("i8")


def sketch(found, bins: int, asked):
    """The least hash of each bin, empty bins densified."""
    import numpy as np

    # sorted hashes, dealt to bins by their top bits: each bin is a run, its least hash the first
    at = ((found >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(at, return_index=True)
    least = np.zeros(bins, "u8")
    has = np.zeros(bins, bool)
    least[full.astype("i8")], has[full.astype("i8")] = found[first], True
    if len(full) < bins:
        empty = np.flatnonzero(~has)
        hits = has[asked[empty]]
        chosen = asked[empty, np.argmax(hits, 1)]
        chosen = np.where(hits.any(1), chosen, full[0].astype("i8"))
        least[empty] = least[chosen] + np.uint64(0)
    return least


def two_bits(values):
    """The lowest two bits of each value, 32 of them to a 64-bit integer."""
    import numpy as np

    two = np.zeros(-(-len(values) // 32) * 32, "u8")
    two[: len(values)] = values & np.uint64(3)
    return np.bitwise_or.reduce(two.reshape(-1, 32) << (2 * np.arange(32, dtype="u8")), axis=1).view("i8")


def parities(found):
    """For each of PARITIES bits, whether an odd number of shingles have it, as 64-bit integers."""
    import numpy as np

    odd = np.bincount((found % np.uint64(PARITIES)).astype("i8"), minlength=PARITIES) & 1
    return np.packbits(odd.astype("u1")).view("i8")


def unequal_parities(x: str, y: str) -> Column:
    """A lower bound of the number of shingles that only one of two members has."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"{x}_parity_{k}").bitwiseXOR(F.col(f"{y}_parity_{k}"))) for k in range(PARITIES // 64)))


def unequal_bins(x: str, y: str, longs: int) -> Column:
    """In how many bins the two bits of two members differ."""
    each = [F.col(f"{x}_print_{k}").bitwiseXOR(F.col(f"{y}_print_{k}")) for k in range(longs)]
    low = F.lit(0x5555555555555555)
    return reduce(Column.__add__, (F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(low)) for v in each))


def most_unequal(size: Column, bins: int, similarity: float, sigmas: float) -> Column:
    """How many bins may differ between sets as similar as that; the smaller one has `size` shingles.

    Bins of a small set that were borrowed tell nothing new, so only those that it fills count as draws.
    """
    p = 0.75 * (1 - similarity)
    drawn = bins * (1 - F.exp(-size / F.lit(float(bins))))
    return bins * (p + sigmas * F.sqrt(p * (1 - p) / drawn))


def _sketcher(width: int, bands: int, rows: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        asked = donors(bands * rows)
        longs = -(-bands * rows // 32)
        salt = mixed(np.arange(bands * rows, dtype="u8") // np.uint64(rows) + np.uint64(1))
        with np.errstate(over="ignore"):
            for b in batches:
                sizes, sets, keys, prints, odds = [], [], [], [], []
                for _, texts in text_runs(b.column(1), SLICE_BYTES):
                    for text in texts:
                        found = shingles(text, width)
                        sizes.append(len(found))
                        sets.append(xxhash.xxh3_128_digest(found.tobytes()))
                        odds.append(parities(found).tolist())
                        if len(found):
                            least = mixed(sketch(found, bands * rows, asked) ^ salt).reshape(bands, rows)
                            total = least[:, 0]
                            for k in range(1, rows):
                                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
                            keys.append(total.view("i8"))
                            prints.append(two_bits(least.ravel()))
                        else:
                            keys.append(np.zeros(0, "i8"))
                            prints.append(np.zeros(longs, "i8"))
                ends = np.cumsum([0, *map(len, keys)])
                flat = np.concatenate([*keys, np.zeros(0, "i8")])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array([x.tolist() for x in prints], pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands", "print", "parity"])

    return run


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def sketches(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_id (a 128-bit digest of the set), bands (bucket keys), print (two bits of each bin), parity of docs (doc_id, text)."""
    rows_in = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows_in.mapInArrow(_sketcher(width, bands, rows), f"doc_id {id_type(docs)}, n_shingles long, set_id binary, bands array<long>, print array<long>, parity array<long>")


def _confirmer(width: int, similarity: tuple[int, int]):
    """Of rows (a, b, text of the other, text of the hub), a and b where the full sets reach the similarity."""
    part, of = similarity

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hub, hubs_set = None, None
        with np.errstate(over="ignore"):
            for b in batches:
                linked = []
                for at, texts in text_runs(b.column(2), SLICE_BYTES):
                    for k, text in enumerate(texts, at):
                        if (new := b.column(3)[k].as_py() or b"") != hub:
                            hub, hubs_set = new, shingles(new, width)
                        own = shingles(text, width)
                        shared = len(own) + len(hubs_set) - len(np.union1d(own, hubs_set))
                        linked.append(of * shared >= part * (len(own) + len(hubs_set) - shared))
                rows = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"])
                yield rows.filter(pa.array(linked, pa.bool_()))

    return run


def near(shared: Column, left: Column, right: Column, similarity: tuple[int, int]) -> Column:
    """Whether shared / (left + right - shared) reaches the similarity, in whole numbers."""
    part, of = similarity
    return of * shared >= part * (left + right - shared)


def links(docs: DataFrame, classes: DataFrame, width: int, similarity: tuple[int, int], bins: int = BANDS * ROWS, sigmas: float | None = SIGMAS) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between classes (rep, n_shingles, bands, print, parity), and their components."""
    longs, (part, of) = -(-bins // 32), similarity
    buckets = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))
    longs_of = {"parity": PARITIES // 64} | ({"print": longs} if sigmas is not None else {})
    prints = [F.col(name)[k].alias(f"{name}_{k}") for name, n in longs_of.items() for k in range(n)]
    members = classes.select(F.col("rep").alias("id"), F.col("n_shingles").alias("size"), *prints)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))

    def close(x: str, y: str) -> Column:
        a, b = F.col(f"{x}_size"), F.col(f"{y}_size")
        sizes = near(F.least(a, b), a, b, similarity)
        odd = (of + part) * unequal_parities(x, y) <= (of - part) * (a + b)
        if sigmas is None:
            return sizes & odd
        return sizes & odd & (unequal_bins(x, y, longs) <= most_unequal(F.least(a, b), bins, part / of, sigmas))

    def confirm(pairs: DataFrame) -> DataFrame:
        other = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        wanted = pairs.select("a", "b", "hub", other.alias("id"))
        wanted = wanted.join(texts.withColumnRenamed("text", "other_text"), "id").drop("id")
        wanted = wanted.join(texts.withColumnsRenamed({"id": "hub", "text": "hub_text"}), "hub")
        return wanted.select("a", "b", "other_text", "hub_text").mapInArrow(_confirmer(width, similarity), f"a {id_type(docs)}, b {id_type(docs)}").distinct()

    return star_links(buckets, members, close, confirm)


def groups(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS, sigmas: float | None = SIGMAS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document (doc_id, text)."""
    own = written(sketches(docs, width, bands, rows), "sketches")
    live = own.where(F.col("n_shingles") > 0).where(F.col("doc_id").isNotNull())
    classes = live.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("print").alias("print"), F.first("parity").alias("parity"))
    classes = written(classes, "classes")
    _, named = links(docs, classes, width, similarity, bands * rows, sigmas)
    named = named.withColumnRenamed("node", "rep").withColumnRenamed("component", "part")
    placed = classes.select("set_id", "rep").join(named, "rep", "left").select("set_id", F.coalesce("part", "rep").alias("part"))
    return (
        own.drop("bands", "print", "parity")
        .join(placed, "set_id", "left")
        .withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", (F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("kept"))
    )


def deduplicate(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs' rows less those near a document with a smaller id; rows that repeat an id are one document, and stay or go together."""
    return with_ids(docs, groups(docs.select("doc_id", "text"), width, similarity).where("kept"))
