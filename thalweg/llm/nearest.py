"""Approximate maximum inner product search by score-aware anisotropic quantisation.

Vectors are cut into pairs of components, each quantised to one of 16 centres (four
bits). Codes and centres minimise a residual error in which the part parallel to the
vector weighs more than the rest, since it is what moves large inner products. A search
scans the codes with a table of partial products of each query, times the vectors' norms, and ranks the best
exactly, in double precision, on the original vectors. Codes are those of the vectors' directions.

Centres are fitted on SAMPLE vectors at most (chosen by a hash of id and vector); every
vector is indexed. Queries pass in blocks of QUERY_BLOCK, each of them one broadcast
of bounded size, one at a time; each task keeps the nearest of its own vectors for each query. Equal
vectors of a slice are scanned once and expanded by ascending id, so copies push
nothing out of the candidates.

Defined results: vectors that are null, zero, of another length than most of the
sample, or hold nulls or non-finite numbers, and rows without an id take no part; rows
that repeat an id are candidates each on its own, but one query (with the least vector);
equal scores go by the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from thalweg.session import written

SAMPLE = 20_000
CENTRES = 16
PAIR = 2
ROUNDS = 6
#: The score-aware weight comes from this share of a vector's norm.
THRESHOLD = 0.2
NEAREST = 20
#: Candidates that are ranked exactly, of so many vectors at most.
RERANK, RERANK_OF = 120, 2500
QUERY_BLOCK = 8192
_ROW = "query_id long, vec_id long, score double"


def takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def parallel_weight(dimensions: int, threshold: float = THRESHOLD) -> float:
    """How much more the parallel part of a residual weighs than the rest."""
    return max(1.0, (dimensions - 1) * threshold**2 / (1 - threshold**2))


def unit(x):
    """Rows of norm 1: their directions are quantised, and the norms kept as they are."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _padded(x):
    import numpy as np

    return np.pad(x, ((0, 0), (0, -x.shape[1] % PAIR)))


def encode(x, centres, extra: float, rounds: int = 2):
    """Codes (rows, pairs) by coordinate descent on the anisotropic loss."""
    import numpy as np

    x = _padded(x)
    parts = x.reshape(len(x), -1, PAIR)
    norm = (x * x).sum(1)
    codes = np.zeros(parts.shape[:2], "u1")
    along = np.zeros(parts.shape[:2])  # <residual, vector> of each pair
    for turn in range(rounds):
        for m in range(parts.shape[1]):
            own = parts[:, m]
            loss = ((own[:, None] - centres[m]) ** 2).sum(2)
            inner = (own * own).sum(1)[:, None] - own @ centres[m].T
            rest = (along.sum(1) - along[:, m])[:, None] if turn else 0.0
            codes[:, m] = np.argmin(loss + extra * (rest + inner) ** 2 / norm[:, None], 1)
            along[:, m] = inner[np.arange(len(x)), codes[:, m]]
    return codes


def fit(x, threshold: float = THRESHOLD, rounds: int = ROUNDS, seed: int = 7):
    """(centres (pairs, 16, 2), extra weight of the parallel part) for the sample x."""
    import numpy as np

    extra = parallel_weight(x.shape[1], threshold) - 1
    x = _padded(x)
    parts, norm = x.reshape(len(x), -1, PAIR), (x * x).sum(1)
    start = np.random.default_rng(seed).choice(len(x), CENTRES, replace=len(x) < CENTRES)
    centres = parts[start].transpose(1, 0, 2).copy()
    for turn in range(rounds):
        codes = encode(x, centres, extra if turn else 0.0)
        chosen = np.take_along_axis(centres[None], codes.T[None, :, :, None].repeat(PAIR, 3), 2)[0].transpose(1, 0, 2)
        along = ((parts - chosen) * parts).sum(2)
        for m in range(parts.shape[1]):
            own, weight = parts[:, m], (extra if turn else 0.0) / norm
            reach = along.sum(1) - along[:, m] + (own * own).sum(1)
            for c in range(CENTRES):
                at = codes[:, m] == c
                if at.any():
                    a = at.sum() * np.eye(PAIR) + (own[at] * weight[at, None]).T @ own[at]
                    centres[m, c] = np.linalg.solve(a, own[at].sum(0) + (own[at] * (weight * reach)[at, None]).sum(0))
    return centres, extra


def exact(queries, vectors):
    """Inner products (queries, candidates) in double precision, summed in order of the components."""
    import numpy as np

    total = np.zeros(vectors.shape[:2])
    for j in range(vectors.shape[2]):
        total += queries[:, None, j] * vectors[:, :, j]
    return total


def scan(queries, codes, norms, centres, most: int):
    """For each query the places of the `most` codes with the largest approximate product, times the norms."""
    import numpy as np

    q = _padded(queries).reshape(len(queries), -1, PAIR)
    tables = np.einsum("qmp,mcp->qmc", q, centres).astype("f4")
    if tables.shape[1] % 2:  # two four-bit codes make one byte and one look-up
        tables, codes = np.pad(tables, ((0, 0), (0, 1), (0, 0))), np.pad(codes, ((0, 0), (0, 1)))
    pairs = (tables[:, ::2, :, None] + tables[:, 1::2, None, :]).reshape(len(q), tables.shape[1] // 2, -1)
    joint = codes[:, ::2].astype("u2") * CENTRES + codes[:, 1::2]
    scores = np.zeros((len(q), len(codes)), "f4")
    for m in range(joint.shape[1]):
        scores += pairs[:, m][:, joint[:, m]]
    scores *= norms.astype("f4")
    if most >= len(codes):
        return np.broadcast_to(np.arange(len(codes)), scores.shape)
    return np.argpartition(-scores, most - 1, axis=1)[:, :most]


class Best:
    """The nearest of the vectors seen so far for each query of a block."""

    def __init__(self, ids, queries, k: int):
        import numpy as np

        self.ids, self.queries, self.k = ids, queries, k
        self.rows = (np.zeros(0, "i8"), np.zeros(0), np.zeros(0, "i8"))  # query's place, score, vec_id
        self.floor = np.full(len(ids), -np.inf)

    def see(self, vec_ids, vectors, codes, centres, rerank: int) -> None:
        import numpy as np

        order = np.argsort(vec_ids, kind="stable")
        vec_ids, vectors, codes = vec_ids[order], vectors[order], codes[order]
        raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, group = np.unique(raw, return_index=True, return_inverse=True)
        members = np.argsort(group, kind="stable")  # by group, ids ascending
        begin = np.searchsorted(group[members], np.arange(len(first) + 1))
        wide = vectors.astype("f8")
        norms = np.sqrt((wide[first] ** 2).sum(1))
        found = []
        for a in range(0, len(self.ids), 256):
            q = self.queries[a : a + 256]
            places = scan(q, codes[first], norms, centres, rerank)
            scores = exact(q, wide[first[places]])
            at, col = np.nonzero(scores >= self.floor[a : a + 256, None])
            groups, s = places[at, col], scores[at, col]
            # of equal vectors the k + 1 smallest ids will do, one of which may be the query's own
            n = np.minimum(begin[groups + 1] - begin[groups], self.k + 1)
            flat = np.repeat(begin[groups] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            ids = vec_ids[members[flat]]
            who = np.repeat(at, n) + a
            other = ids != self.ids[who]
            found.append((who[other], np.repeat(s, n)[other], ids[other]))
        who, s, ids = (np.concatenate([old, *new]) for old, new in zip(self.rows, zip(*found, strict=True), strict=True))
        order = np.lexsort((ids, -s, who))
        who, s, ids = who[order], s[order], ids[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        self.rows = who[keep], s[keep], ids[keep]
        last = rank == self.k - 1
        self.floor[who[last]] = s[last]


def _matrix(column):
    import numpy as np

    values = column.values.to_numpy(zero_copy_only=False) if not column.offset else column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.reshape(len(column), -1))


def index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, object, float] | None:
    """(vec_id, embedding, code) of all vectors that take part, the centres, the extra weight."""
    import numpy as np

    live = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    n = live.count()
    if not n:
        return None
    share = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int(min(1.0, 0.9 * sample / n) * (1 << 30))
    drawn = live.where(share) if n > sample else live
    # equal rows are drawn together: any will do where the draw has none, and no more than the sample where it has many
    rows = drawn.select("embedding").limit(sample).collect() or live.select("embedding").limit(sample).collect()
    sizes = [len(r[0]) for r in rows]
    dimensions = max(sorted(set(sizes)), key=sizes.count)
    centres, extra = fit(unit(np.array([r[0] for r in rows if len(r[0]) == dimensions], "f8")))
    model = vectors.sparkSession.sparkContext.broadcast((centres, extra))

    def code(batches):
        import pyarrow as pa

        centres, extra = model.value
        for b in batches:
            if b.num_rows:
                codes = encode(unit(_matrix(b.column(1)).astype("f8")), centres, extra)
                if codes.shape[1] % 2:
                    codes = np.pad(codes, ((0, 0), (0, 1)))
                packed = codes[:, ::2] << 4 | codes[:, 1::2]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in packed], pa.binary())], ["vec_id", "embedding", "code"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    coded = live.where(F.size("embedding") == dimensions).mapInArrow(code, f"vec_id long, embedding {kind}, code binary")
    return written(coded, "index"), centres, extra


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all other rows for each row that is_query."""
    import numpy as np

    spark = vectors.sparkSession
    made = index(vectors, sample)
    found = spark.createDataFrame([], _ROW)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if made:
        coded, centres, _ = made
        model = spark.sparkContext.broadcast(centres)
        nearest_of = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
        queries = coded.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        before = None
        for ids, block in _blocks(queries):
            if before is not None:  # one block is held at a time
                found = found.unionByName(written(nearest_of(before[0]), "nearest"))
                before[1].destroy()
            sent = spark.sparkContext.broadcast((ids, np.array(block, "f8")))
            before = coded.mapInArrow(_searcher(sent, model, k, rerank), _ROW), sent
        if before is not None:
            found = found.unionByName(before[0])
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame):
    import numpy as np

    ids, block = [], []
    for vec_id, vector in queries.toLocalIterator():
        ids.append(vec_id)
        block.append(vector)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids), block
            ids, block = [], []
    if ids:
        yield np.array(ids), block


def _searcher(block, model, k: int, rerank: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, queries = block.value
        best = Best(ids, queries, k)
        for b in batches:
            if not b.num_rows:
                continue
            vectors = _matrix(b.column(1))
            packed = np.frombuffer(b"".join(b.column(2).to_pylist()), "u1").reshape(len(vectors), -1)
            codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(vectors), -1)[:, : model.value.shape[0]]
            vec_ids = b.column(0).to_numpy()
            for a in range(0, len(vectors), RERANK_OF):
                some = slice(a, a + RERANK_OF)
                best.see(vec_ids[some], vectors[some], codes[some], model.value, rerank)
        who, scores, vec_ids = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(vec_ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run
