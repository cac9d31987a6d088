"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has points on a ring, and a document goes to the shard of the first point
clockwise from its own hash. No shard takes more than its even share of the rows (so
counts are at most one apart): what a full shard cannot take continues clockwise to the
next one with room. First every shard takes its own documents, in ring order, up to its
share; then the surplus goes on in ring order. Only counts for each arc of the ring,
a fixed number, are needed to see which ranks of an arc go where; documents are ranked
side by side in cells of an arc and meet the fixed-size plan in a broadcast join.

Defined results: a null text has no bytes; a null id hashes as the word null; rows with
the same id lie next to each other, ordered by size and checksum. Where docs have a
column of a result's name, theirs stays and the result's name gets an underscore.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from thalweg.llm.tables import apart, free_name

SHARDS = 16
POINTS = 128
#: Rows that a cell of the ring, which one task ranks, holds on average at most.
CELL_ROWS = 50_000
#: Hashes are the first 15 hexadecimal digits of md5.
HASH_BITS = 60
BIN_BITS = 12


def ring_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def ring(shards: int, points: int) -> list[tuple[int, int]]:
    """(hash, shard) of all points in order."""
    return sorted((int(hashlib.md5(f"{s}:{p}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for p in range(points))


def arcs(nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(bin, above, to, arc): arc i ends at point i; those across several bins have a row for each."""
    width, rows = 1 << (HASH_BITS - BIN_BITS), []
    ends = [h for h, _ in nodes]
    for a, (low, high) in enumerate(zip([-1, *ends], [*ends, (1 << HASH_BITS) - 1], strict=True)):
        if low < high:
            rows += [(b, low, high, a % len(ends)) for b in range((low + 1) // width, high // width + 1)]
    return rows


def plan(nodes: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, slot of the first) for all rows of all arcs."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used, rows, over = [0] * shards, [], {}

    def place(arc: int, first: int, most: int, s: int) -> int:
        k = min(most, room[s] - used[s])
        if k > 0:
            rows.append((arc, first, first + k, s, used[s]))
            used[s] += k
        return max(k, 0)

    for a, (_, s) in enumerate(nodes):
        own = counts.get(a, 0)
        over[a] = place(a, 0, own, s)
    for a in range(len(nodes)):
        first, step = over[a], 1
        while first < counts.get(a, 0):
            first += place(a, first, counts[a] - first, nodes[(a + step) % len(nodes)][1])
            step += 1
    return rows


def shard(docs: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot (gapless from 0 in a shard) and grown_shard."""
    spark = docs.sparkSession
    nodes = ring(shards, points)
    on_ring = spark.createDataFrame(arcs(nodes), "_bin long, _above long, _to long, _arc long")  # 2^12 rows and one for each point
    named = {c: free_name(c, docs) for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")}
    docs, own = apart(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    new = {"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary")), "_hash": ring_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))}

    def placed(rows: DataFrame) -> DataFrame:
        in_arc = (F.shiftright("_hash", HASH_BITS - BIN_BITS) == F.col("_bin")) & (F.col("_hash") > F.col("_above")) & (F.col("_hash") <= F.col("_to"))
        return rows.join(F.broadcast(on_ring), in_arc).drop("_bin", "_above", "_to")

    counts = dict(placed(docs.select(new["_hash"].alias("_hash"))).groupBy("_arc").count().collect())  # one row for each point
    bits = max(0, (sum(counts.values()) // CELL_ROWS).bit_length())
    rows = placed(docs.withColumns(new)).withColumn("_cell", F.shiftright("_hash", HASH_BITS - bits))
    cells = placed(docs.select(new["_hash"].alias("_hash"))).groupBy("_arc", F.shiftright("_hash", HASH_BITS - bits).alias("_cell")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows")
    order = Window.partitionBy("_arc", "_cell").orderBy("_hash", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("_own", F.row_number().over(order) - 1)
    if bits:
        ranked = ranked.join(cells, ["_arc", "_cell"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    else:
        ranked = ranked.withColumn("_rank", F.col("_own"))
    to = spark.createDataFrame(plan(nodes, counts, shards), "_for long, _first long, _end long, shard int, _slot long")  # bounded by points and shards
    found = ranked.join(F.broadcast(to), (F.col("_arc") == F.col("_for")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    result = (F.col("size"), F.col("text_crc32"), F.lit("rows"), F.col("shard"), F.col("_slot") + F.col("_rank") - F.col("_first"), F.lit(None).cast("int"))
    return found.select(*own, *(c.alias(n) for c, n in zip(result, named.values(), strict=True)))
