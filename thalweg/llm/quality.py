"""Quality by interpolated modified Kneser-Ney models of trusted text.

The model's n-grams are runs of ORDER characters, counted over all documents that labels
trust (good quality, not toxic). Documents are dealt out into blocks of about BLOCK_BYTES
by a hash of their ids, and their labels with them. A block gives its distinct n-grams,
each with how often it occurs in its trusted and in its toxic documents. Summed over the
blocks these are both the counts and the n-grams that are asked for: tables, dealt out
by n-gram, that are joined from the shortest order up, which gives each n-gram its
interpolated probability. These are joined with the blocks' n-grams and go back to the
blocks, where the documents' logarithms are summed: a document's perplexity is that of
its characters. No block's n-grams are more than its characters, no task holds more than
the n-grams of a block and one pack of documents, and nothing passes through the driver.

Three measures reject a document. Its perplexity; short texts say little, so SMOOTHING
characters of the language's mean are added. Its worst word, since a few words that trusted text
doesn't have are lost in the mean: the least mean logarithm over the characters of one
of its words (what stands between white space) of at least LEAST_LETTERS characters. And
its toxicity, since toxic words may be made of what trusted text has too: how much likelier its words are
if a share TOXIC_WORDS of them follows the toxic documents, whose counts are added to
TOXIC_PRIOR of the trusted model's, as the sum of the logarithms of that ratio over the words.

Each is held against the language's quantile of trusted documents that one in HELD_OUT,
by a hash of the id, is kept out of the model's counts for, since the model knows the
texts it was counted on too well (without any, those it was counted on stand in); see
limits() for languages of few documents. Words that are no likelier for being toxic
never reject.

Characters rather than words, since n-grams of words of a corpus are nearly as many as
its words, and every one of them would have to cross the network.

Defined results: null and empty texts have no n-grams, the language's mean perplexity,
and stay; without a word of LEAST_LETTERS characters there is no worst one (null); a null
language is a language of its own; several labels of an id must all trust it, and one
toxic one makes it toxic; without any trusted text nothing is rejected (perplexity null).
Rows with the same id are scored each by its text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.tables import with_ids
from thalweg.session import discard, written

ORDER = 5
QUANTILE = 0.99
MARGIN = 1.1
#: The quantile of the worst word and of toxicity.
TAIL = 0.995
SMOOTHING = 60
LEAST_LETTERS = 4
HELD_OUT = 5
FEW = 20
TOXIC_WORDS = 0.02
TOXIC_PRIOR = 30
#: Bytes of text in a block.
BLOCK_BYTES = 64 << 20
#: Bytes of text that are packed together on their way to a block, and that a task holds for all blocks.
PACK_BYTES, HELD_BYTES = 1 << 20, 48 << 20
#: Distinct n-grams that a task holds before it hands them on.
HELD_GRAMS = 1_000_000
#: Characters whose probabilities a task holds at once.
SCORED_CHARS = 1_000_000
#: Characters in which the end of a slice of a long text looks for white space.
LOOK_BACK = 10_000
START = "\x02"
# White space.
SPACES = [*map(ord, "\t\n\x0b\x0c\r\x85\xa0\u3000 ")]
TRUSTED, TOXIC = 1, 2


def trusted_ids(labels: DataFrame) -> DataFrame:
    return _judged(labels).where((F.col("q") == 1) & (F.col("t") == 0)).select("doc_id")


def _judged(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))


def _held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0


def characters(texts: list[str], order: int):
    """(characters of all texts, each after order - 1 starts; where each text begins)."""
    import numpy as np

    pad = START * (order - 1)
    flat = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts], "i8") + order - 1
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def hashes(flat, order: int):
    """A 64-bit hash of the run of characters that begins at each place."""
    import numpy as np

    n = max(0, len(flat) - order + 1)
    h = np.zeros(n, "u8")
    for k in range(order):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += flat[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _inside(begins, order: int, n: int):
    """Which places begin a run that lies within one text."""
    import numpy as np

    inside = np.ones(n, bool)
    for k in range(1, order):
        at = begins[1:-1] - k
        inside[at[(at >= 0) & (at < n)]] = False
    return inside


PACK = "block int, kind int, ids array<{id}>, langs array<string>, sizes array<int>, texts binary"


def _packer(batches):
    """Packs of documents (block, doc_id, lang, text): their ids, languages, sizes in bytes, and texts, compressed together."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(3).compress
    held: dict[int, list] = {}
    sizes: dict[int, int] = {}

    def rows(blocks, kind):
        packed = [tuple(zip(*held.pop(k), strict=True)) for k in blocks]
        for k in blocks:
            del sizes[k]
        columns = [pa.array(blocks, pa.int32()), pa.array(np.ones(len(blocks), "i4")), pa.array([ids for ids, _, _ in packed], pa.list_(kind)), pa.array([langs for _, langs, _ in packed], pa.list_(pa.string()))]
        columns += [pa.array([list(map(len, texts)) for _, _, texts in packed], pa.list_(pa.int32())), pa.array([squeeze(b"".join(texts)) for _, _, texts in packed], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "kind", "ids", "langs", "sizes", "texts"])

    kind = None
    for b in batches:
        kind = b.schema.field(1).type
        for block, *row in zip(*(b.column(i).to_pylist() for i in range(3)), (t or b"" for t in b.column(3).to_pylist()), strict=True):
            held.setdefault(block, []).append(row)
            sizes[block] = sizes.get(block, 0) + len(row[2])
            if sizes[block] > PACK_BYTES:
                yield rows([block], kind)
        if sum(sizes.values()) > HELD_BYTES:
            yield rows(list(held), kind)
    if held:
        yield rows(list(held), kind)


def _unpacked(batch, i: int):
    """(number of the first text, texts) of a pack's texts, in runs of at most SCORED_CHARS bytes or one text."""
    import zstandard

    flat = zstandard.ZstdDecompressor().decompress(batch.column("texts")[i].as_py())
    run, first, held, at = [], 0, 0, 0
    for n in batch.column("sizes")[i].as_py():
        if run and held + n > SCORED_CHARS:
            yield first, run
            first, run, held = first + len(run), [], 0
        run.append(flat[at : at + n].decode())
        held += n
        at += n
    if run:
        yield first, run


def packs(docs: DataFrame, blocks: int) -> DataFrame:
    """Packs (block, kind 1, ids, langs, sizes, texts) of docs (doc_id, lang, text), not yet dealt out."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"), "doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_packer, PACK.format(id=kind))


def _dealt(few: DataFrame, packed: DataFrame, blocks: int) -> DataFrame:
    """A partition for each block: what comes with it first (kind 0), then its packs."""
    both = few.withColumn("kind", F.lit(0)).unionByName(packed, allowMissingColumns=True)
    return both.repartitionById(blocks, "block").sortWithinPartitions("kind")


def _counter(order: int):
    """(block, gram, trusted, toxic) of a block's labels (kind 0: id, flag) and packs."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        flags: dict = {}
        block = None
        names = ["block", "gram", "trusted", "toxic"]
        none = (np.zeros(0, "u8"), np.zeros((0, order), "u4"), np.zeros(0), np.zeros(0))

        def distinct(h, at, flat, label):
            codes, found = pd.factorize(h)
            first = np.empty(len(found), "i8")
            first[codes[::-1]] = at[::-1]
            return found, flat[first[:, None] + np.arange(order)], *(np.bincount(codes[label == k], minlength=len(found)) for k in (TRUSTED, TOXIC))

        def merged(parts):
            h, grams, good, bad = (np.concatenate(x) for x in zip(*parts, strict=True))
            found, first, of = np.unique(h, return_index=True, return_inverse=True)
            return found, grams[first], np.bincount(of, good, len(found)), np.bincount(of, bad, len(found))

        def rows(part):
            grams = part[1].astype("<u4").view(f"<U{order}").ravel().tolist() if len(part[1]) else []
            # numpy drops zeros at the end of a string
            grams = pa.array([g.ljust(order, "\0") for g in grams], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block, "i4")), grams, pa.array(part[2].astype("i8")), pa.array(part[3].astype("i8"))], names)

        held, fresh, n_fresh = none, [], 0
        for b in batches:
            for i, kind in enumerate(b.column("kind").to_pylist()):
                block = b.column("block")[i].as_py()
                if kind == 0:
                    flags[b.column("id")[i].as_py()] = b.column("flag")[i].as_py()
                    continue
                of = [flags.get(d, 0) for d in b.column("ids")[i].as_py()]
                for first, texts in _unpacked(b, i):
                    for some, begins in _slices(texts, order):
                        h = hashes(some, order)
                        at = np.flatnonzero(_inside(begins, order, len(h)))
                        label = np.repeat(np.array(of[first : first + len(texts)]), np.diff(begins))[at]
                        fresh.append(distinct(h[at], at, some, label))
                        n_fresh += len(fresh[-1][0])
                        if n_fresh > max(len(held[0]), HELD_GRAMS // 2):
                            held, fresh, n_fresh = merged([held, *fresh]), [], 0
                            if len(held[0]) > HELD_GRAMS:
                                yield rows(held)
                                held = none
        if block is not None:
            yield rows(merged([held, *fresh]))

    return run


def _slices(texts: list[str], order: int):
    """(characters, where each text begins) of texts; of a single long one, of slices that end after white space where there is some.

    A later slice begins with the order - 1 characters before it instead of starts.
    """
    import numpy as np

    flat, begins = characters(texts, order)
    if len(texts) > 1 or len(flat) <= 2 * SCORED_CHARS:
        yield flat, begins
        return
    begin, end = 0, 0
    while end < len(flat):
        end = min(len(flat), begin + SCORED_CHARS)
        if end < len(flat):
            gaps = np.flatnonzero(np.isin(flat[end - LOOK_BACK : end], SPACES))
            end -= LOOK_BACK - 1 - int(gaps[-1]) if len(gaps) else 0
        yield flat[begin:end], np.array([0, end - begin])
        begin = end - order + 1


def asked(docs: DataFrame, flags: DataFrame, blocks: int, order: int = ORDER) -> DataFrame:
    """block, gram, trusted, toxic: each block's distinct n-grams, counted in its documents by flags (doc_id, flag)."""
    few = flags.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").alias("id"), "flag")
    return _dealt(few, packs(docs, blocks), blocks).mapInArrow(_counter(order), "block int, gram string, trusted long, toxic long")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts of n-grams seen once, twice, and more often."""
    n1, n2, n3, n4 = counts.agg(*(F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4))).first()
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def probabilities(wanted: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, p: the interpolated probability of each wanted gram's last character after the others.

    wanted: gram; trusted: gram, n. Every order is a join of the wanted n-grams of that
    order with the counts, the contexts, and the probabilities of the order below.
    """
    counts, wants = {order: trusted}, {order: wanted.select("gram")}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct characters before a gram
        counts[k] = written(counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"counts-{k}")
        wants[k] = written(wants[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct(), f"wanted-{k}")
    found = None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(counts[k])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = counts[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("weight"))
        own = counts[k].select("gram", (F.col("n") - cut).alias("mass"))
        rows = wants[k].join(own, "gram", "left").withColumn("context", F.substring("gram", 1, k - 1)).join(contexts, "context", "left")
        if k == 1:
            size = counts[1].count() + 1  # characters, and one for those never seen
            rows = rows.withColumn("below", F.lit(1.0 / size))
        else:
            rows = rows.withColumn("shorter", F.substring("gram", 2, k - 1)).join(found.select(F.col("gram").alias("shorter"), F.col("p").alias("below")), "shorter")
        p = F.coalesce(F.col("mass") / F.col("total"), F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("below")
        shorter, found = found, written(rows.select("gram", p.alias("p")), f"p-{k}")
        if k > 1:
            discard(shorter)
    discard(*(t for tables in (counts, wants) for k, t in tables.items() if k < order))
    return found


def answers(wanted: DataFrame, p: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, log_p, ratio (of the toxic to the trusted probability, as a logarithm) of wanted (gram, trusted, toxic); p: gram, p."""
    context = F.substring("gram", 1, order - 1)
    toxic = wanted.where("toxic > 0").select("gram", "toxic")
    contexts = toxic.groupBy(context.alias("context")).agg(F.sum("toxic").alias("total"))
    found = p.join(toxic, "gram", "left").withColumn("context", context).join(contexts, "context", "left")
    ratio = F.ln((F.coalesce("toxic", F.lit(0)) / F.col("p") + TOXIC_PRIOR) / (F.coalesce("total", F.lit(0)) + TOXIC_PRIOR))
    return found.select("gram", F.ln("p").cast("float").alias("log_p"), ratio.cast("float").alias("ratio"))


def _answer_packer(order: int):
    """(block, kind 0, answers: hashes, logarithms and ratios) of rows (block, gram, log_p, ratio)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            flat = np.frombuffer("".join(t.ljust(order, "\0") for t in b.column(1).to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, order)
            rows = np.zeros(len(flat), [("h", "<u8"), ("log_p", "<f4"), ("ratio", "<f4")])
            rows["h"], rows["log_p"], rows["ratio"] = hashes_of_rows(flat), b.column(2).to_numpy(), b.column(3).to_numpy()
            blocks = b.column(0).to_numpy()
            order_of = np.argsort(blocks, kind="stable")
            found, begins = np.unique(blocks[order_of], return_index=True)
            parts = [rows[x].tobytes() for x in np.split(order_of, begins[1:])] if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(parts, pa.binary())], ["block", "answers"])

    return run


def hashes_of_rows(rows):
    """hashes() of the one run that each row is."""
    import numpy as np

    order, flat = rows.shape[1], rows.ravel()
    return hashes(flat, order)[::order] if len(flat) else np.zeros(0, "u8")


def words(flat):
    """(begins, ends) of the runs of characters between white space."""
    import numpy as np

    letter = ~np.isin(flat, [*SPACES, ord(START)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype("i1")))
    return edges[::2], edges[1::2]


def _scorer(order: int):
    """(doc_id, lang, n_chars, log_p, worst, toxicity) of a block's answers (kind 0) and packs."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        raw, table = [], None
        names = ["doc_id", "lang", "n_chars", "log_p", "worst", "toxicity"]
        for b in batches:
            for i, is_pack in enumerate(b.column("kind").to_pylist()):
                if not is_pack:
                    raw.append(b.column("answers")[i].as_py())
                    continue
                if table is None:
                    rows = np.frombuffer(b"".join(raw), [("h", "<u8"), ("log_p", "<f4"), ("ratio", "<f4")])
                    raw, rows = [], rows[np.argsort(rows["h"])]
                    table = np.ascontiguousarray(rows["h"]), np.append(rows["log_p"], 0.0).astype("f8"), np.append(rows["ratio"], 0.0).astype("f8")
                keys, log_p, ratio = table
                ids, langs = b.column("ids").slice(i, 1).flatten(), b.column("langs").slice(i, 1).flatten()
                n = len(ids)
                chars, total, worst, toxicity = np.zeros(n, "i8"), np.zeros(n), np.full(n, np.inf), np.zeros(n)
                for first, texts in _unpacked(b, i):
                    chars[first : first + len(texts)] = [len(t) for t in texts]
                    for flat, begins in _slices(texts, order):
                        h = hashes(flat, order)
                        at = np.flatnonzero(_inside(begins, order, len(h)))
                        codes, found = pd.factorize(h[at])
                        place = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
                        place = np.where(keys[place] == found, place, len(keys)) if len(keys) else np.zeros(len(found), "i8")
                        # the n-gram of a character begins order - 1 places before it
                        logs, ratios = np.zeros(len(flat)), np.zeros(len(flat))
                        logs[at + order - 1], ratios[at + order - 1] = log_p[place][codes], ratio[place][codes]
                        sums, so_far = np.concatenate([[0.0], np.cumsum(logs)]), np.concatenate([[0.0], np.cumsum(ratios)])
                        total[first : first + len(texts)] += sums[begins[1:]] - sums[begins[:-1]]
                        start, end = words(flat)
                        if not len(start):
                            continue
                        owner = first + np.searchsorted(begins, start, "right") - 1
                        grown = np.log1p(TOXIC_WORDS * np.expm1(np.minimum(so_far[end] - so_far[start], 50.0)))
                        toxicity += np.bincount(owner, grown, n)
                        long = end - start >= LEAST_LETTERS
                        np.minimum.at(worst, owner[long], ((sums[end] - sums[start]) / (end - start))[long])
                yield pa.RecordBatch.from_arrays([ids, langs, pa.array(chars), pa.array(total), pa.array(worst, mask=np.isinf(worst)), pa.array(toxicity)], names)

    return run


def likelihoods(docs: DataFrame, flags: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_chars, and of each row's characters: log_p, the sum of the logarithms of their probabilities;
    worst, the least mean of a word; toxicity, the sum over words of the logarithm of how much likelier toxic ones make them.

    flags: doc_id, flag: TRUSTED ones are the model, TOXIC ones what is told apart.
    """
    docs = docs.select("doc_id", "lang", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20)))
    blocks = max(1, least, -(-size // block_bytes))
    grams = written(asked(docs, flags, blocks, order), "asked")
    wanted = written(grams.groupBy("gram").agg(F.sum("trusted").alias("trusted"), F.sum("toxic").alias("toxic")), "wanted")
    p = probabilities(wanted, wanted.where("trusted > 0").select("gram", F.col("trusted").alias("n")), order)
    found = grams.select("block", "gram").join(answers(wanted, p, order), "gram").select("block", "gram", "log_p", "ratio")
    told = written(found.mapInArrow(_answer_packer(order), "block int, answers binary"), "answers")
    discard(grams, wanted, p)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = _dealt(told, packs(docs, blocks), blocks).mapInArrow(_scorer(order), f"doc_id {kind}, lang string, n_chars long, log_p double, worst double, toxicity double")
    found = written(scored, "likelihoods")
    discard(told)
    return found


def limits(known: DataFrame, measures: dict[str, float]) -> tuple[DataFrame, dict[str, float]]:
    """(lang_, and for each measure its limit by language; each measure's limit for languages without documents).

    measures: column -> quantile. A limit is the language's quantile and median as n
    documents, beside those of all languages as FEW, and lies FEW / (n + FEW) of the
    way between the two beyond the quantile: the fewer documents tell, the more it allows.
    """
    both = lambda m, q: F.percentile_approx(m, F.array(F.lit(q), F.lit(0.5)), F.lit(100_000)).alias(m)
    quantiles = [both(m, q) for m, q in measures.items()]
    every = known.agg(*quantiles).first()
    own = known.groupBy(F.col("lang").alias("lang_")).agg(*quantiles, F.count("*").alias("n"))

    def limit(m: str) -> Column:
        high, middle = ((F.col("n") * F.col(m)[k] + FEW * F.lit(every[m][k])) / (F.col("n") + FEW) if every[m] else F.col(m)[k] for k in (0, 1))
        return (high + (high - middle) * FEW / (F.col("n") + FEW)).alias(m)

    return own.select("lang_", *map(limit, measures)), {m: 2 * every[m][0] - every[m][1] if every[m] else None for m in measures}


def scores(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, tail: float = TAIL) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, worst_word (its perplexity), worst_threshold, toxicity, toxic_threshold, keep of docs (doc_id, lang, text)."""
    judged = written(_judged(labels).select("doc_id", F.when(F.col("t") > 0, TOXIC).when(F.col("q") == 1, F.when(_held_out(), -TRUSTED).otherwise(TRUSTED)).alias("flag")).where("flag is not null"), "labels")
    scored = likelihoods(docs, judged.where("flag > 0"), order).withColumn("worst", -F.col("worst"))
    for flag in (-TRUSTED, TRUSTED):
        known = scored.join(judged.where(F.col("flag") == flag), "doc_id", "left_semi")
        total = known.agg(F.try_divide(F.sum("log_p"), F.sum("n_chars"))).first()[0]
        if total is not None:
            break
    shown = ("perplexity", "threshold", "worst_word", "worst_threshold", "toxicity", "toxic_threshold")
    if total is None:
        return scored.select("doc_id", "lang", "n_chars", *(F.lit(None).cast("double").alias(c) for c in shown), F.lit(True).alias("keep"))
    means = written(known.groupBy(F.col("lang").alias("_lang")).agg(F.try_divide(F.sum("log_p"), F.sum("n_chars")).alias("mean")), "means")

    def smoothed(rows: DataFrame) -> DataFrame:
        mean = F.coalesce("mean", F.lit(total))
        log_p = (F.col("log_p") + SMOOTHING * mean) / (F.col("n_chars") + SMOOTHING)
        return rows.join(means, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("loss", -log_p).drop("_lang", "mean")

    measures = {"loss": quantile, "worst": tail, "toxicity": tail}
    own, overall = limits(smoothed(known), measures)
    own = own.select("lang_", *(F.col(m).alias(f"{m}_limit") for m in measures))
    found = smoothed(scored).join(own, F.col("lang").eqNullSafe(F.col("lang_")), "left")
    of = {m: F.coalesce(f"{m}_limit", F.lit(overall[m]).cast("double")) for m in measures}
    of["loss"], of["toxicity"] = of["loss"] + math.log(margin), F.greatest(of["toxicity"], F.lit(0.0))
    keep = (F.col("loss") <= of["loss"]) & F.coalesce(F.col("worst") <= of["worst"], F.lit(True)) & (F.col("toxicity") <= of["toxicity"])
    values = (F.exp("loss"), F.exp(of["loss"]), F.exp("worst"), F.exp(of["worst"]), F.col("toxicity"), of["toxicity"])
    return found.select("doc_id", "lang", "n_chars", *(v.alias(c) for v, c in zip(values, shown, strict=True)), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' rows without the rejected ones (an id goes if all of its rows are rejected)."""
    return with_ids(docs, scores(docs, labels).where("keep").select("doc_id"))
