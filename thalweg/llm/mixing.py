"""Mixing sources to target weights by pivotal dependent rounding.

Each document is to be taken target / source size times. The whole part of that number
is certain; of the fractions, pairs are taken within a source and mass is moved at
random from one to the other until one of them is 0 or 1, so that the words of the pair
stay as they were and each expectation is kept. Chunks of a source do so side by side
and leave one fraction each; these meet in a reduction tree until one of each source is
left, which is drawn. So a source's taken words differ from its target by less than the
words of one document.

Defined results: a null text has no words and is taken with none; a null source is a
source of its own, the last; documents that agree in id, source and size share one
decision; all targets are 0 where there are no words; reruns draw alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.tables import apart, in_order
from thalweg.session import discard, written

WEIGHTS = (1, 2, 3)
#: No target above so many times its source's size, no document taken more often.
MOST_COPIES = 3
#: Documents of a chunk, and chunks whose fractions meet in a node of the tree.
CHUNK_ROWS = 4096
FAN_IN = 1024
_UNIT = "position long, source string, doc_id long, size long, words long, chunk long, base int, fraction double"


def word_count(column: str = "text"):
    """Number of words of a text, between the white space of ASCII."""
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, units, position, target of sizes (source, source_size, units).

    Sources by code point, null last, weigh weights, repeating. Targets share all words
    by weight, stop at most times the source's size, and the excess is reshared until
    none is above: each is min(most * size, rate * weight) for the one rate that fits.
    """
    ranked = in_order(sizes.withColumn("_null", F.col("source").isNull()), "_null", "source").drop("_null")
    ranked = written(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))), "sources")
    cap, rate, before = most * F.col("source_size"), 0.0, -1.0
    while rate > before:  # each round caps one source more at least
        before = rate
        full = (cap <= F.lit(rate) * F.col("weight")) | (cap == 0)
        total, capped, free = ranked.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            rate = float("inf")
            break
        rate = max(rate, (total - (capped or 0)) / free)
    target = F.least(cap.cast("double"), F.lit(rate) * F.col("weight")) if rate < float("inf") else cap.cast("double")
    return ranked.select("source", "source_size", "units", "position", target.alias("target"))


def pivot(words: list[int], fractions: list[float], draw) -> int | None:
    """Round fractions in place, pair by pair; the place of the one that stays, if any."""
    left = None
    for j in range(len(fractions)):
        if not 0 < fractions[j] < 1:
            continue
        if left is None:
            left = j
            continue
        i, a, b, f, g = left, words[left], words[j], fractions[left], fractions[j]
        up, down = min((1 - f) * a, g * b), min(f * a, (1 - g) * b)
        move = up if draw() * (up + down) < down else -down
        f, g = f + move / a, g - move / b
        # one of the two is whole but for the last bit
        if min(f, 1 - f) <= min(g, 1 - g):
            f = float(round(f))
        else:
            g = float(round(g))
        fractions[i], fractions[j] = f, g
        left = i if 0 < f < 1 else j if 0 < g < 1 else None
    return left


def _rounder(seed: int, level: int, last: bool):
    def settle(rows):
        import numpy as np

        # long documents first: the one that is left is then a short one, as a rule
        rows = rows.sort_values(["words", "doc_id", "size", "chunk"], ascending=[False, True, True, True], ignore_index=True)
        draw = np.random.default_rng([seed, level, int(rows["position"][0]), int(rows["chunk"][0])]).random
        fractions = rows["fraction"].tolist()
        left = pivot(rows["words"].tolist(), fractions, draw)
        if last and left is not None:
            fractions[left] = float(draw() < fractions[left])
        return rows.assign(fraction=fractions)

    return settle


def mix_decisions(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row for each distinct (doc_id, source, size)."""
    units = docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    targets = written(source_targets(sizes), "targets")
    chunks = F.ceil(F.col("units") / CHUNK_ROWS)
    share = F.least(F.lit(float(MOST_COPIES)), F.col("target") / F.col("source_size"))
    units = (
        units.withColumnRenamed("source", "_source")
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("share", F.when(F.col("size") > 0, share).otherwise(0.0))
        .select("position", "source", "doc_id", "size", (F.col("size") * F.col("rows")).alias("words"), F.pmod(F.xxhash64("doc_id", "size"), chunks).alias("chunk"), F.floor("share").cast("int").alias("base"), (F.col("share") - F.floor("share")).alias("fraction"))
    )
    widest = targets.agg(F.max(chunks)).first()[0] or 1
    level, settled = 0, []
    while True:
        last = widest <= 1
        units = written(units.groupBy("position", "chunk").applyInPandas(_rounder(seed, level, last), _UNIT), f"level-{level}")
        between = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        settled.append(units.where(~between))
        if last:
            break
        units = units.where(between).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
        widest, level = -(-widest // FAN_IN), level + 1
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    targets = targets.select("position", "source_size", "target")
    return whole.join(targets, "position").select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("fraction").cast("int")).alias("copies"))


def _decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    named = decisions.withColumnsRenamed({"doc_id": "_id", "source": "_source", "size": "_words"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_words"))
    return docs.join(named, same)


def mix_sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each document (doc_id, source, text)."""
    sized = written(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    found = _decided(sized.withColumnRenamed("size", "_size"), mix_decisions(sized, seed))
    return found.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken."""
    docs, own = apart(docs, "doc_id", "source", "text")
    sized = docs.withColumn("_size", word_count())
    sizes = written(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    decisions = written(mix_decisions(sizes, seed).where("copies > 0").select("doc_id", "source", "size", "copies"), "decisions")
    discard(sizes)
    taken = _decided(sized, decisions)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*own)
