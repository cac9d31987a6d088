"""The prefix trie against a plain one of dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from thalweg.llm import prefix_trie
from thalweg.llm.prefix_trie import BLOCK, FIRST, block_end, block_of

SCHEMA = "conv_id long, turn long, role string, text string, depth string, class string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain_turns(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in found.items()}


def plain_rebuilt(convs):
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return made


def plain_trie(convs):
    members = defaultdict(list)
    for c, own in sorted(convs.items()):
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    below = defaultdict(list)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    childless = {p for p in members if not any(len(q) == len(p) + 1 for q in below[p])}
    found = set()
    for p, cs in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        ends = ",".join(str(c) for c in cs if len(convs[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        found.add((cs[0], len(p), parent, len(cs), sum(len(q) == len(p) + 1 for q in below[p]), sum(q in childless for q in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return found


def rows_of(nodes):
    rows = [tuple(r) for r in nodes.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def hard_rows():
    """Nulls, ties, repeats, equal, nested and long conversations."""
    r = random.Random(3)
    words = ["a", "b", "é", "", None]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(words)) for c in range(40) for t in range(r.randrange(9))]
    for c in range(50, 62):  # copies and beginnings of one another, past the first blocks
        rows += [(c, t, "user", f"turn {t}") for t in range(30 if c < 58 else c - 45)]
    rows += [(70, None, "user", "first"), (70, None, "user", "a tie"), (70, 0, None, None), (70, 0, None, None), (71, 5, "user", "a tie"), (71, 9, "user", "first")]
    return rows + [(None, 0, "user", "nobody's"), (4_000_000_000, 0, "user", "a")]


def test_trie_equals_a_plain_one(spark):
    rows = hard_rows()
    assert rows_of(prefix_trie.prefix_trie(frame(spark, rows).repartition(3))) == plain_trie(plain_turns(rows))


def test_rebuilt_conversations_equal_plain_ones(spark):
    rows = [x for x in hard_rows() if x[0] is None or x[0] % 10]  # most have nothing to begin with
    turns = prefix_trie.numbered(frame(spark, rows))
    found = rows_of(prefix_trie.trie(*prefix_trie.rebuilt(turns)))
    assert found == plain_trie(plain_rebuilt(plain_turns(rows)))
    assert any(x[1] == 0 and x[2] is None for x in found)


def test_long_conversations_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    monkeypatch.setattr(prefix_trie, "CHAIN", 100)
    rows = [(c, t, "user", str(t)) for c in (1, 2) for t in range(2 * BLOCK + 50 + c)] + [(2, 9999, "user", "an end"), (2, 9998, "user", "near it")]
    rows += [(c, 0, "user", "the same") for c in range(100, 200)]
    found = rows_of(prefix_trie.prefix_trie(frame(spark, rows)))
    same = [x for x in found if x[0] == 100]
    ids = ",".join(map(str, range(100, 200)))
    assert same == [(100, 1, 1, 100, 0, 1, 99 * 8, hashlib.sha256(ids.encode()).hexdigest())]
    shared = 2 * BLOCK + 51
    assert {x[3] for x in found if x[0] == 1 and 0 < x[1] <= shared} == {2}
    assert sum(x[0] == 2 for x in found) == 3 and max(x[1] for x in found) == shared + 3
    assert next(x for x in found if x[1] == 0)[6] == 99 * 8 + sum(len(str(t)) for t in range(shared))


@pytest.mark.parametrize("rows", [[], [(7, 0, "user", "only")], [(None, 0, "user", "x")]])
def test_few_conversations(spark, rows):
    assert rows_of(prefix_trie.prefix_trie(frame(spark, rows))) == (plain_trie(plain_turns(rows)) if any(r[0] for r in rows) else set())


def test_blocks_are_where_rounds_end(spark):
    at = [0, 1, FIRST - 1, FIRST, 7, 8, 15, 16, 511, 512, BLOCK - 1, BLOCK, 2 * BLOCK - 1, 2 * BLOCK, 3 * BLOCK]
    found = spark.createDataFrame([(a,) for a in at], "at long").select("at", block_of(F.col("at")).alias("b")).collect()
    assert all((block_end(b - 1) if b else 0) <= a < block_end(b) for a, b in found)


def test_nodes_have_their_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, None, None)]
    turns = frame(spark, rows)
    found = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in prefix_trie.node_turns(prefix_trie.prefix_trie(turns), turns).collect()}
    assert found == {(1, 1): ("user", "hi"), (1, 2): ("assistant", "yes"), (2, 2): ("", "")}
