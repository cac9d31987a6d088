"""The prefix trie of conversations, by partition refinement.

All conversations begin as one class. Each round splits the active classes by their
members' next turns: a class is named by the chain of hashes of the turns that its
members share, so that a member finds its new class by itself, and only the counts of
classes are shuffled. A class of one is retired: its tail is a unary chain that needs no
further rounds. A round sees the turns of a block (4, 4, 8, 16, ... turns, up to BLOCK),
so that conversations that share thousands of turns take few rounds.

Subtrees are folded back without a walk: the least member of a class owns its node, and
owns all nodes below it on its own path. So a sum over a subtree is a sum over members:
each one counts from where it begins to own. Leaves are counted likewise.

Defined results: rows without an id take no part; null roles and texts are empty; turns
go by turn (null first), then role, then text; repeated rows are turns each on its own; a
conversation may be turnless; no conversations give no nodes. Columns of other names
don't matter.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.tables import in_order
from thalweg.session import discard, written

#: Turns that a round sees at most.
BLOCK = 1024
#: Turns of the first round.
FIRST = 4
#: Ids that are joined in one row to be hashed; nodes where more conversations end are hashed run by run.
RUN = 4096
#: Depths of a unary chain that one row unfolds to at once.
CHAIN = 8192
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 0 in a conversation), key (of role and text), size (UTF-8 bytes of the text).

    Turns are numbered by ranges of the whole table, so that a long conversation isn't one task's.
    """
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(" "), "role", "text").cast("binary")))
    own = own.select("conv_id", "turn", "role", "text", key.alias("key"), F.octet_length("text").cast("long").alias("size"))
    placed = in_order(own, "conv_id", "turn", "role", "text", keep=("conv_id", "key", "size"))
    firsts = placed.groupBy("conv_id").agg(F.min("position").alias("first"))
    return placed.join(firsts, "conv_id").select("conv_id", (F.col("position") - F.col("first")).alias("at"), "key", "size")


def block_of(at: Column) -> Column:
    """Which round sees a turn."""
    doubling = F.length(F.bin(at)) - FIRST.bit_length() + 1
    last = (BLOCK // FIRST).bit_length() - 1
    return F.when(at < FIRST, 0).when(at < BLOCK, doubling).otherwise(last + (at / BLOCK).cast("long")).cast("int")


def block_end(block: int) -> int:
    """How many turns the rounds up to this one see."""
    last = (BLOCK // FIRST).bit_length() - 1
    return FIRST << block if block <= last else (block - last + 1) * BLOCK


def _refined(packed: DataFrame, ids: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(members (conv_id, depth, class) of all classes of two or more; classes (class, parent, depth, before, n, owner)), by rounds.

    before: bytes of the turns that a class shares but for its last. Classes of one are
    there from where they become one to the end of the round.
    """
    root = F.lit(b"").alias("class")
    active = ids.select("conv_id", root, F.lit(0).cast("long").alias("before"))
    members = [ids.select("conv_id", F.lit(0).cast("long").alias("depth"), root)]
    none = F.lit(None).cast("binary").alias("parent")
    classes = [ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("owner")).select(root, none, F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"), "n", "owner")]
    block = 0
    while True:
        begin = block_end(block - 1) if block else 0
        step = "(path, x) -> concat(path, array(named_struct('class', unhex(md5(concat(element_at(path, -1).class, x.key))), 'before', element_at(path, -1).before + x.size)))"
        path = F.expr(f"aggregate(turns, array(named_struct('class', class, 'before', before)), {step})")
        paths = packed.where(F.col("block") == block).join(active, "conv_id").select("conv_id", path.alias("path"))
        each = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda j: F.struct((j + begin).cast("long").alias("depth"), F.get("path", j)["class"].alias("class"), F.get("path", j - 1)["class"].alias("parent"), F.get("path", j - 1)["before"].alias("before"), F.get("path", j)["before"].alias("after"))))
        seen = written(paths.select("conv_id", each.alias("_n")).select("conv_id", "_n.*"), f"seen-{block}")
        found = written(seen.groupBy("class", "parent", "depth", "before").agg(F.count("*").alias("n"), F.min("conv_id").alias("owner")), f"classes-{block}")
        classes.append(found)
        alone = found.where("n = 1").groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("alone"))
        shared = written(seen.join(alone, "conv_id", "left").where("alone is null or depth < alone").select("conv_id", "depth", "class", "after"), f"members-{block}")
        discard(seen)
        members.append(shared.select("conv_id", "depth", "class"))
        active = shared.where(F.col("depth") == block_end(block)).select("conv_id", "class", F.col("after").alias("before"))
        if not active.take(1):
            return members, classes
        block += 1


def _ends(ended: DataFrame) -> DataFrame:
    """class, ends_sha256: of the ids (class, conv_id) of the conversations that end at a node."""
    counts = ended.groupBy("class").agg(F.count("*").alias("n"))
    sized = ended.join(counts, "class")
    joined = lambda: F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    few = sized.where(F.col("n") <= RUN).groupBy("class").agg(F.sha2(joined(), 256).alias("ends_sha256"))
    if not counts.where(F.col("n") > RUN).take(1):
        return few
    placed = in_order(sized.where(F.col("n") > RUN).select("class", "conv_id"), "class", "conv_id")
    runs = placed.groupBy("class", F.floor(F.col("position") / RUN).alias("run")).agg(joined().alias("ids"))

    def digest(batches):
        import pyarrow as pa

        name, sha = None, None
        for b in batches:
            for c, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c == name:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([sha.hexdigest()])], ["class", "ends_sha256"])
                name, sha = c, hashlib.sha256(ids.encode())
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([sha.hexdigest()])], ["class", "ends_sha256"])

    many = runs.repartition("class").sortWithinPartitions("class", "run").mapInArrow(digest, "class binary, ends_sha256 string")
    return few.unionByName(many)


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of turns (conv_id, at, key, size) of the conversations ids (conv_id).

    conv_id: the least of the conversations that begin with the node's turns; depth: how
    many these are; parent_conv_id: that of the node above; n_convs, n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (over the subtree, each node's
    conversations but one times the bytes of its last text), ends_sha256 (of the ids of
    the conversations that end here, ascending, joined by commas).
    """
    packed = written(turns.groupBy("conv_id", block_of(F.col("at")).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "key", "size"))).alias("turns")).sortWithinPartitions("block"), "blocks")
    lengths = packed.groupBy("conv_id").agg(F.sum(F.size("turns")).alias("length"), F.sum(F.aggregate("turns", F.lit(0).cast("long"), lambda t, x: t + x["size"])).alias("bytes"))
    convs = written(ids.select("conv_id").join(lengths, "conv_id", "left").fillna(0, ["length", "bytes"]), "conversations")
    members, classes = (reduce(DataFrame.unionByName, x) for x in _refined(packed, convs))
    several = convs.limit(2).count() > 1
    members = members if several else members.where("false")
    # from where a conversation owns its nodes, and how far it shares them
    owned = classes.groupBy(F.col("owner").alias("conv_id")).agg(F.min(F.struct("depth", "before")).alias("own"))
    last = members.groupBy("conv_id").agg(F.max(F.struct("depth", "class")).alias("last"))
    states = convs.join(last, "conv_id", "left").join(owned, "conv_id", "left")
    states = written(states.select("conv_id", "length", F.coalesce("last.depth", F.lit(-1)).alias("shared"), F.col("last.class").alias("class"), "own.depth", F.coalesce("own.before", "bytes").alias("above")), "states")
    children = classes.where("parent is not null").groupBy(F.col("parent").alias("class")).agg(F.count("*").alias("n_children"))
    shared = classes.where("n > 1").join(children, "class", "left").fillna(0, ["n_children"])
    shared = written(shared, "shared")
    leaves = shared.where("n_children = 0").select(F.col("owner").alias("conv_id"), F.lit(1).alias("leaf"))
    folded = states.join(leaves, "conv_id", "left").select("conv_id", F.col("depth").alias("own_depth"), "above", F.when(F.col("length") > F.col("shared"), 1).otherwise(F.coalesce("leaf", F.lit(0))).alias("leaf"))
    counted = F.col("own_depth").isNull() | (F.col("own_depth") > F.col("depth"))
    sums = members.join(folded, "conv_id").groupBy("class").agg(F.sum("leaf").alias("n_leaves"), F.coalesce(F.sum(F.when(counted, F.col("above"))), F.lit(0)).alias("above"))
    names = shared.select(F.col("class").alias("parent"), F.col("owner").alias("parent_conv_id"))
    ends = _ends(states.where("shared = length").select("class", "conv_id"))
    top = shared.join(sums, "class").join(names, "parent", "left").join(ends, "class", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    saved = F.col("above") - (F.col("n") - 1) * F.col("before")
    top = top.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    # unary chains: from the last shared node to the conversation's end
    tails = states.where("length > shared").join(names.withColumnRenamed("parent", "class"), "class", "left")
    pieces = F.explode(F.sequence(F.col("shared") + 1, F.col("length"), F.lit(CHAIN).cast("long")))
    tails = tails.select("conv_id", "shared", "length", "parent_conv_id", pieces.alias("begin")).repartition(*([F.col("conv_id"), F.col("begin")]))
    chain = tails.withColumn("depth", F.explode(F.sequence("begin", F.least(F.col("begin") + CHAIN - 1, F.col("length")))))
    end = F.col("depth") == F.col("length")
    above = F.when(F.col("depth") == F.col("shared") + 1, F.col("parent_conv_id")).otherwise(F.col("conv_id"))
    one = F.lit(1).cast("long")
    ends_here = F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(nothing))
    chain = chain.select("conv_id", "depth", above.alias("parent_conv_id"), one.alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ends_here.alias("ends_sha256"))
    return top.unionByName(chain).select(*_NODE)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes (see trie) of conversations as they are: turns (conv_id, turn, role, text)."""
    placed = written(numbered(turns), "turns")
    return trie(placed, placed.select("conv_id").distinct())


#: How conversations are rebuilt: each from the first of its GROUP, by up to HEADS - 1 turns.
GROUP, HEADS = 5, 9


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) with shared beginnings: the first h turns of conversation c - c % 5, then c's own after its first h; h is crc32(c) % 9."""
    lengths = written(placed.groupBy("conv_id").agg(F.count("*").alias("length")), "lengths")
    head = lengths.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))).alias("base"))
    head = head.join(lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("of")), "base", "left").withColumn("taken", F.least("h", F.coalesce("of", F.lit(0))))
    early = placed.where(F.col("at") < HEADS - 1).withColumnRenamed("conv_id", "base")
    begin = early.join(head, "base").where("at < h").select("conv_id", "at", "key", "size")
    rest = placed.join(head, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "key", "size")
    return begin.unionByName(rest), lengths.select("conv_id")


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes but the root with role and text of their last turn, which is the owner's: turns (conv_id, turn, role, text) as they were given to prefix_trie."""
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = in_order(own, "conv_id", "turn", "role", "text", keep=("conv_id", "role", "text"))
    firsts = placed.groupBy("conv_id").agg(F.min("position").alias("first"))
    placed = placed.join(firsts, "conv_id").select("conv_id", (F.col("position") - F.col("first") + 1).alias("depth"), "role", "text")
    return nodes.join(placed, ["conv_id", "depth"])
