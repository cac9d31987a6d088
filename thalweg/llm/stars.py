"""Links between the members of buckets by star-shaped candidates, whole but without all pairs.

In each bucket the members stand in order, those first that meet the most others over
all of their buckets: an original meets each of its altered copies, these meet fewer of
one another. The first is the centre of a star: it is compared with all others. Links
found are confirmed and joined to components; buckets whose members are all of one
component are done. In the others the next members are centres, 4 times as many each
round, for those of other components only, until every member has been a centre. A group
of thousands of near copies so costs a star or two; only members that resemble nothing
in their bucket meet one by one.

Sizes are counts with partial sums, and the rest are joins, whose large keys adaptive
execution can split. Centres are found by a limited rank that each task applies before
the shuffle, up to Spark's limit of 1000 rows; from the sixth round on (1024 centres) the
rank takes what is left of a bucket, more than 341 members, to one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from thalweg.operators.components import components
from thalweg.session import discard, written

GROWTH = 4


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def star_links(buckets: DataFrame, members: DataFrame, close: Callable[[str, str], Column], confirm: Callable[[DataFrame], DataFrame], spent: tuple[DataFrame, ...] = (), growth: int = GROWTH) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), components (node, component)) of buckets (bucket, id) of members (id, and what close needs).

    bucket: any key. close(x, y): a condition on the columns of two members, x_... and
    y_..., that all links meet. confirm: keeps of pairs (a, b, hub: the centre's id)
    those that are links. spent: written tables that only buckets and members read, which
    are removed before the rounds. growth: by how much centres grow each round.
    """
    attributes = members.columns
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = written(buckets.join(sizes, "bucket"), "buckets")
    most_met = met.groupBy("id").agg(F.sum("n").alias("n"))
    turn = F.struct((-F.col("n")).alias("n"), F.xxhash64("bucket", "id").alias("h"), F.col("id").alias("i"))
    live = written(met.drop("n").join(members.join(most_met, "id"), "id").select("bucket", turn.alias("turn"), F.col("id").alias("part"), *attributes), "members")
    discard(met, *spent)
    tried, compared, found, named, centres = [], [], [], None, 1
    while live.take(1):
        before = live
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("turn"))
        first = written(live.withColumn("_rank", rank).where(F.col("_rank") <= centres).drop("_rank"), f"centres-{centres}")
        x = first.select("bucket", F.col("turn").alias("x_turn"), F.col("part").alias("x_part"), *(F.col(c).alias(f"x_{c}") for c in attributes))
        y = live.select("bucket", "turn", "part", *(F.col(c).alias(f"y_{c}") for c in attributes))
        pairs = y.join(x, "bucket").where((F.col("turn") > F.col("x_turn")) & (F.col("part") != F.col("x_part")) & close("x", "y"))
        pairs = pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), F.col("x_id").alias("hub")).groupBy("a", "b").agg(F.min("hub").alias("hub"))
        if compared:
            pairs = pairs.join(all_of(compared), ["a", "b"], "left_anti")
        pairs = written(pairs, f"pairs-{centres}")
        tried.append(pairs)
        if pairs.take(1):
            compared.append(pairs.select("a", "b"))
            found.append(written(confirm(pairs).select("a", "b"), f"links-{centres}"))
            stars = [named.select(F.col("component").alias("a"), F.col("node").alias("b"))] if named else []
            named = components(all_of([found[-1], *stars]))
        last = first.groupBy("bucket").agg(F.max("turn").alias("last"))
        live = live.join(last, "bucket").where("turn > last").drop("last")
        if named:
            live = live.drop("part").join(named.withColumnsRenamed({"node": "id", "component": "part"}), "id", "left").withColumn("part", F.coalesce("part", "id"))
        live = live.select("bucket", "turn", "part", *attributes)
        several = live.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("bucket")
        centres *= growth
        rest = written(live.join(several, "bucket"), f"live-{centres}")
        discard(before, first)
        live = rest
    discard(live, *tried)
    if not found:
        kind = buckets.schema["id"].dataType.simpleString()
        none = buckets.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
        return none, none.withColumnsRenamed({"a": "node", "b": "component"})
    return all_of(found), named


def bucket_links(buckets: DataFrame, members: DataFrame, close: Callable[[str, str], Column], confirm: Callable[[DataFrame], DataFrame], spent: tuple[DataFrame, ...] = (), few: int = 31) -> tuple[DataFrame, DataFrame]:
    """What star_links returns; members of buckets of at most few are compared with one another at once, others by stars that grow by few.

    confirm: gets hubs from stars only. Pairs whose members the larger buckets have joined
    aren't confirmed.
    """
    attributes = members.columns
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = written(buckets.join(sizes, "bucket").join(members, "id").select("bucket", "n", *attributes), "members")
    discard(*spent)
    small, large = met.where(F.col("n") <= few), met.where(F.col("n") > few)
    x, y = (small.select("bucket", *(F.col(c).alias(f"{side}_{c}") for c in attributes)) for side in ("x", "y"))
    pairs = x.join(y, "bucket").where((F.col("x_id") < F.col("y_id")) & close("x", "y"))
    pairs = written(pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct(), "pairs")
    found, stars, rest = [], [], pairs
    if large.take(1):
        links, named = star_links(large.select("bucket", "id"), large.select(*attributes).dropDuplicates(["id"]), close, confirm, growth=few)
        found, stars = [links], [named.select(F.col("component").alias("a"), F.col("node").alias("b"))]
        for c in ("a", "b"):
            rest = rest.join(named.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")), c, "left")
        rest = rest.where("part_a is null or part_b is null or part_a <> part_b").select("a", "b")
    discard(met)
    found.append(written(confirm(rest).select("a", "b"), "links"))
    named = components(all_of([found[-1], *stars]))
    discard(pairs)
    return all_of(found), named
