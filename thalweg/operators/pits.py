"""Single-cell pits: cells below all eight neighbours, and their breaching.

Breaching is sequential: pits are visited row by row, and later ones see what earlier
ones changed. A pit sees cells two steps away and changes some a step away, so it depends
only on earlier pits within three steps. Tiles breach their own pits in order, and tell
their neighbours what they change near the border, with the pit that does so: these
edits take their places in the others' order. A tile whose neighbours tell something new
runs again, until none does. Since each pit depends on earlier ones only, that settles at
what a single pass over the whole raster gives, after as many rounds as dependencies
cross borders one after the other; few do.

With a chunk size, the chunks of that size are breached each on its own, as the usual
tools do: pits don't see what others change beyond the chunk, and nothing they change
beyond it is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions.d8 import EPSILON_GRADIENT, STEPS
from thalweg.operators.grid import neighbours, shuffled
from thalweg.operators.raster import FRAME, KEY, Raster, each, kept, layer, padded, to_cells, to_raster, with_strips
from thalweg.operators.tiles import TILE
from thalweg.session import discard, few_tiles, written, written_tiles

# The ring of 16 cells two steps away, in the order of visits, each with
# the cell one step away that is lowered for it.
RING = (
    ((-2, 2), (-1, 1)), ((-1, 2), (-1, 1)), ((0, 2), (0, 1)), ((1, 2), (0, 1)),
    ((2, 2), (1, 1)), ((2, 1), (1, 1)), ((2, 0), (1, 0)), ((2, -1), (1, 0)),
    ((2, -2), (1, -1)), ((1, -2), (1, -1)), ((0, -2), (0, -1)), ((-1, -2), (0, -1)),
    ((-2, -2), (-1, -1)), ((-2, -1), (-1, -1)), ((-2, 0), (-1, 0)), ((-2, 1), (-1, 1)),
)
HALO = 2


def single_cell_pits(cells: DataFrame) -> DataFrame:
    """row, col, z of the cells whose 8 neighbours all have data and are strictly higher."""
    higher = F.forall("near", lambda n: F.coalesce(n["z"] > F.col("z"), F.lit(False)))
    return neighbours(cells, "z").where(F.col("z").isNotNull() & higher).select("row", "col", "z")


def pits_of(z):
    """The places of the pits of z (NaN: nodata), row by row; none within two cells of the border."""
    import numpy as np

    h, w = z.shape
    if min(h, w) < 5:
        return np.zeros((0, 2), int)
    mid = z[2:-2, 2:-2]
    pit = ~np.isnan(mid)
    for dr, dc in STEPS:
        pit &= z[2 + dr : h - 2 + dr, 2 + dc : w - 2 + dc] > mid
    return np.argwhere(pit) + 2


def breach_array(z, nodata: float, epsilon: float | None = None, edits=(), told=lambda r, c: False):
    """Breach the pits of z (NaN: nodata) in place: (places of those left, row by row; edits of the told ones).

    A ring cell no higher than the pit, or nodata, lowers the cell before it to their
    mean, where nodata counts as the number `nodata`; with epsilon, the cell before
    nodata goes to the pit's elevation less epsilon instead. The last ring cell wins.
    edits: (row, column, turn, row, column, z): what pits elsewhere, by their places and
    turns, change here; told: for which pits such edits are returned.
    """
    import numpy as np

    flat, width = z.reshape(-1), z.shape[1]
    far_at = np.array([r * width + c for (r, c), _ in RING])
    near_at = np.array([r * width + c for _, (r, c) in RING])
    left, out = [], []
    waiting = sorted(edits, reverse=True)

    def apply(before: tuple[int, int]) -> None:
        while waiting and waiting[-1][:2] < before:
            *_, r, c, value = waiting.pop()
            flat[r * width + c] = value

    for r, c in pits_of(z).tolist():
        apply((r, c))
        at = r * width + c
        own, far = flat[at], flat[at + far_at]
        hit = ~(far > own)
        if not hit.any():
            left.append((r, c))
            continue
        gap = np.isnan(far)
        beyond = own - epsilon if epsilon is not None else (float(own) + nodata) / 2
        new = np.where(gap, np.array(beyond).astype(z.dtype), (own + far) / 2)
        new[new == nodata] = np.nan
        flat[at + near_at[hit]] = new[hit]
        if told(r, c):
            for k in np.flatnonzero(hit).tolist():
                out.append((r, c, k, r + RING[k][1][0], c + RING[k][1][1], float(new[k])))
    apply((z.shape[0], 0))
    return np.array(left, int).reshape(-1, 2), out


_EDIT = "struct<row: bigint, col: bigint, turn: int, y: bigint, x: bigint, z: double>"


def _chunks(size: int, chunk: int | None):
    """The number of a tile's chunk, along one axis, by the tile's."""
    return lambda tile: F.floor(F.col(tile) * size / chunk) if chunk else F.lit(0)


def _incoming(edits: DataFrame, size: int, chunk: int | None) -> DataFrame:
    """tile_row, tile_col, given, digest: the edits (tile_row, tile_col, edits) of others that a tile sees."""
    every = edits.select(F.col("tile_row").alias("from_row"), F.col("tile_col").alias("from_col"), F.inline("edits"))
    near = lambda axis: F.explode(F.sequence(F.floor((F.col(axis) - HALO) / size), F.floor((F.col(axis) + HALO) / size)))
    sent = every.withColumn("tile_row", near("y")).withColumn("tile_col", near("x"))
    sent = sent.where("tile_row >= 0 and tile_col >= 0 and (tile_row <> from_row or tile_col <> from_col)")
    of = _chunks(size, chunk)
    sent = sent.where((of("tile_row") == of("from_row")) & (of("tile_col") == of("from_col")))
    # nodata (NaN) is null, so that sorting and comparing are plain
    edit = F.struct("row", "col", "turn", "y", "x", F.when(~F.isnan("z"), F.col("z")).alias("z"))
    given = sent.groupBy(*KEY).agg(F.array_sort(F.collect_list(edit)).alias("given"))
    return given.withColumn("digest", F.xxhash64("given"))


def raster_pits(raster: Raster, nodata: float, epsilon: float | None = None, chunk: int | None = None) -> Raster:
    """raster (there, z) with z breached and the layer pit: whether a cell is an unsolved pit.

    chunk: the edge of the squares that are breached each on its own, a multiple of the
    raster's tiles; None for the whole raster.
    """
    types, size = raster.types(), raster.size
    base = written_tiles(with_strips(raster, ("z",), HALO), "pits-base")

    def breached(t: dict):
        z = padded(t, "z", types, size, HALO)
        y, x = t["tile_row"] * size - HALO, t["tile_col"] * size - HALO
        height, width = z.shape
        edits = [(g["row"] - y, g["col"] - x, g["turn"], g["y"] - y, g["x"] - x, math.nan if g["z"] is None else g["z"]) for g in t["given"] or ()]
        edits = [e for e in edits if 0 <= e[3] < height and 0 <= e[4] < width]
        rim = 2 * HALO + 1  # its changes reach what a neighbour sees
        left, out = breach_array(z, nodata, epsilon, edits, lambda r, c: min(r, c) < HALO + rim - 1 or r >= height - HALO - rim + 1 or c >= width - HALO - rim + 1)
        return z, left, [{"row": r + y, "col": c + x, "turn": k, "y": a + y, "x": b + x, "z": v} for r, c, k, a, b, v in out]

    def tell(t: dict) -> dict:
        return {"tile_row": t["tile_row"], "tile_col": t["tile_col"], "digest": t["digest"] or 0, "edits": breached(t)[2]}

    told = f"tile_row long, tile_col long, digest long, edits array<{_EDIT}>"
    nothing = base.withColumns({"given": F.lit(None).cast(f"array<{_EDIT}>"), "digest": F.lit(0).cast("long")})
    with few_tiles(base.sparkSession):
        state, k = written(each(nothing, tell, told), "edits-0"), 0
    while True:
        k += 1
        given = written(_incoming(state, size, chunk), f"given-{k}")
        # tiles that were told something else before, or nothing
        before = state.select(*KEY, F.col("digest").alias("_before"))
        changed = before.join(shuffled(given), KEY, "left").where(F.coalesce("digest", F.lit(0)) != F.col("_before")).drop("_before").withColumn("digest", F.coalesce("digest", F.lit(0)))
        if not changed.take(1):
            discard(state)
            break
        again = each(base.join(changed.select(*KEY), KEY, "left_semi").join(shuffled(changed), KEY), tell, told)
        with few_tiles(base.sparkSession):
            new = written(again.unionByName(state.join(changed.select(*KEY), KEY, "left_anti")), f"edits-{k}")
        discard(state, given)
        state = new

    def finish(t: dict) -> dict:
        import numpy as np

        z, left, _ = breached(t)
        pit = np.zeros(z.shape, bool)
        pit[left[:, 0], left[:, 1]] = True
        core = slice(HALO, HALO + t["height"]), slice(HALO, HALO + t["width"])
        return kept("there")(t) | {"z": np.ascontiguousarray(z[core]).tobytes(), "pit": (pit[core] & layer(t, "there", types)).tobytes()}

    found = each(base.join(shuffled(given), KEY, "left"), finish, f"{FRAME}, there binary, z binary, pit binary")
    return Raster(found, size, raster.z, ("there", "z", "pit"))


def breach_single_cell_pits(cells: DataFrame, nodata: float = -9999.0, chunk_size: int | None = None, nodata_outlet: str = "parity", tile: int = TILE) -> DataFrame:
    """row, col, z, pit: cells after the breaching, and whether a cell is an unsolved pit.

    chunk_size: breach squares of so many cells each on its own; None (or a raster no
    larger) breaches the whole raster in one order. nodata_outlet: 'parity' takes nodata
    as the number it is, so that borders may be cut deep; 'epsilon' lowers the cell before
    nodata a little below the pit. The tile's size changes nothing.
    """
    return to_cells(breached_pits(cells, nodata, chunk_size, nodata_outlet, tile), "z", "pit")


def breached_pits(cells: DataFrame, nodata: float, chunk_size: int | None, nodata_outlet: str, tile: int) -> Raster:
    """As breach_single_cell_pits, a raster (there, z, pit)."""
    if nodata_outlet not in ("parity", "epsilon"):
        raise ValueError("nodata_outlet must be parity or epsilon")
    if chunk_size is not None and chunk_size < HALO or tile < HALO:
        raise ValueError(f"the edge of a chunk or tile must be {HALO} at least")
    # tiles fit into chunks; one that has no such part is a tile itself
    size = next((d for d in range(min(tile, chunk_size), HALO - 1, -1) if chunk_size % d == 0), chunk_size) if chunk_size else tile
    raster = to_raster(cells.select("row", "col", F.col("z").cast("float").alias("z")), size)
    return raster_pits(raster, nodata, EPSILON_GRADIENT if nodata_outlet == "epsilon" else None, chunk_size)
