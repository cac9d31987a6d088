"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

UPPER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def closure(nodes, links) -> dict:
    """The least node reachable from each node."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for n in sorted(nodes):
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in found:
                found[x] = n
                stack += near[x]
    return found


def shingle_set(text: str | None, width: int) -> set:
    words = SPACED.findall((text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_groups(docs: dict[int, str | None], width: int, part: int, of: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t, width) for d, t in docs.items()}
    ids = [d for d in sorted(sets) if sets[d]]
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if of * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b])]
    named = closure(docs, links)
    return {d: (len(sets[d]), named[d]) for d in docs}


def contamination(text: str | None, items: list[tuple[str, str]], window: int = 13) -> tuple[int, int, list[str]]:
    words = PLAIN.findall((text or "").translate(UPPER))
    hit, ids = set(), []
    for item, passage in items:
        own = PLAIN.findall((passage or "").translate(UPPER))
        n = min(window, len(own))
        runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in runs] if n else []
        if at:
            ids.append(item)
        for i in at:
            hit.update(range(i, i + n))
    return len(words), len(hit), sorted(set(ids))


def targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Targets of sources by repeated resharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = sum(sizes.values()), {}, list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def simhash(norm: str, hashed: dict[str, int]) -> int:
    """Of the distinct words, as the operator defines it."""
    words = set(norm.split(" "))
    return sum(1 << k for k in range(64) if 2 * sum(hashed[w] >> k & 1 for w in words) > len(words))


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def kneser_ney(trusted: list[str], order: int, discounts) -> callable:
    """p(gram): interpolated modified Kneser-Ney of runs of characters, each text after order - 1 starts."""
    pad = "\x02" * (order - 1)
    counts = {order: Counter(t[i : i + order] for t in (pad + x for x in trusted if x) for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {k: discounts(counts[k]) for k in counts}

    def p(gram: str) -> float:
        k = len(gram)
        if k == 0:
            return 1.0 / (len(counts[1]) + 1)
        same = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        below = p(gram[1:])
        if not same:
            return below
        off = lambda n: cut[k][min(n, 3) - 1]
        n = counts[k].get(gram, 0)
        return (n - off(n) if n else 0) / sum(same) + sum(map(off, same)) / sum(same) * below

    return p
