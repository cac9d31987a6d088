"""Least-cost breaching: each pit is joined with lower ground by the cheapest path.

A search reads the unbreached elevations within its radius, so a tile with strips of its
neighbours as wide as the radius has all that its pits need. The pits of a tile are dealt
to batches, each a row with that window, so that many tasks share a tile full of pits.
The paths' new elevations are merged by their minimum: neither tiles nor batches change
the result.
"""

from __future__ import annotations

import heapq
import math
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions.d8 import DEFAULT_MAX_PITS, DEFAULT_SEARCH_RADIUS, DISTANCES, EPSILON_GRADIENT, STEPS
from thalweg.operators.grid import shuffled
from thalweg.operators.pits import breached_pits
from thalweg.operators.raster import FRAME, KEY, Raster, each, kept, layer, padded, to_cells, to_raster, with_strips
from thalweg.operators.tiles import TILE, arrow_schema, by_tile
from thalweg.session import written_tiles

#: Pits that a batch holds.
BATCH = 1000


class _Reached(float):
    """The cost of a cell on the heap, with its place; heaps compare costs alone, so that ties fall as they are pushed."""

    __slots__ = ("place",)


class Window:
    """Elevations (NaN: nodata) in which pits are joined with lower ground."""

    def __init__(self, z, radius: int):
        self.width, self.radius = z.shape[1], radius
        self.z: list[float] = z.ravel().tolist()
        self.steps = [(dr, dc, dr * self.width + dc, d) for (dr, dc), d in zip(STEPS, DISTANCES, strict=True)]

    def cheapest_path(self, row: int, col: int) -> list[int] | None:
        """The places on the path from an outlet to the pit, or None where there is none within the radius.

        An outlet is lower than the pit, or nodata. A step costs how far the next cell
        rises above the pit, times the distance; one onto nodata is free. Costs are kept
        in single precision.
        """
        z, radius, most = self.z, self.radius, (2 * self.radius + 1) ** 2
        pit = row * self.width + col
        low, nothing = z[pit], -math.inf
        single, far = array("f", [0.0]), math.inf
        costs, before = {pit: 0.0}, {}
        first = _Reached(0.0)
        first.place = pit
        heap = [first]
        while heap:
            cell = heapq.heappop(heap)
            at = cell.place
            here = z[at]
            if here != here or here < low:
                path = [at]
                while path[-1] in before:
                    path.append(before[path[-1]])
                return path
            if len(heap) >= most:
                return None
            cost = float(cell)
            r, c = divmod(at, self.width)
            edge = abs(r - row) == radius or abs(c - col) == radius
            for dr, dc, step, distance in self.steps:
                if edge and (abs(r + dr - row) > radius or abs(c + dc - col) > radius):
                    continue
                to = at + step
                rise = z[to]
                new = cost if rise != rise or rise == nothing else cost + distance * (rise - low)
                if new < costs.get(to, far):
                    single[0] = new
                    reached = _Reached(single[0])
                    reached.place = to
                    costs[to], before[to] = single[0], at
                    heapq.heappush(heap, reached)
        return None

    def path_elevations(self, path: list[int]) -> list[tuple[int, float]]:
        """(place, elevation) of a path's cells but the pit: an even fall from the pit to the outlet.

        Towards nodata, which has no elevation, the fall is the least gradient a step.
        """
        low, end, n = self.z[path[-1]], self.z[path[0]], len(path) - 1
        if math.isnan(end) or end == -math.inf:
            return [(path[j], low - (n - j) * EPSILON_GRADIENT) for j in range(1, n)]
        return [(path[j], end + (low - end) * j / n) for j in range(n)]


_BATCH = "y long, x long, height int, width int, z binary, pits binary"
_NEW = "row long, col long, new_z double"


def raster_paths(raster: Raster, radius: int, batch: int = BATCH) -> DataFrame:
    """row, col, new_z: the new elevations on the paths of the pits of a raster (z, pit), each path's."""
    if isinstance(radius, bool) or not isinstance(radius, int) or radius <= 0:
        raise ValueError("the search radius must be a positive integer")
    if radius > raster.size:
        raise ValueError("the search radius is larger than a tile")
    types, size = raster.types(), raster.size
    batches, new = arrow_schema(_BATCH), arrow_schema(_NEW)

    def deal(rows):
        import numpy as np
        import pyarrow as pa

        for b in rows:
            for k in range(b.num_rows):
                t = b.slice(k, 1).to_pylist()[0]
                places = np.argwhere(layer(t, "pit", types))
                if not len(places):
                    continue
                z = padded(t, "z", types, size, radius)
                whole = {"y": t["tile_row"] * size - radius, "x": t["tile_col"] * size - radius, "height": z.shape[0], "width": z.shape[1], "z": z.tobytes()}
                n = -(-len(places) // batch)
                for i in range(n):  # each takes pits from all over the tile
                    yield pa.RecordBatch.from_pylist([whole | {"pits": (places[i::n] + radius).astype("i4").tobytes()}], schema=batches)

    def search(rows):
        import numpy as np
        import pyarrow as pa

        for b in rows:
            for k in range(b.num_rows):
                t = b.slice(k, 1).to_pylist()[0]
                window = Window(layer(t, "z", types), radius)
                found: list[tuple[int, float]] = []
                for row, col in np.frombuffer(t["pits"], "i4").reshape(-1, 2).tolist():
                    path = window.cheapest_path(row, col)
                    if path:
                        found += window.path_elevations(path)
                at = np.array([p for p, _ in found], "i8")
                yield pa.RecordBatch.from_arrays([pa.array(at // t["width"] + t["y"]), pa.array(at % t["width"] + t["x"]), pa.array([v for _, v in found], pa.float64())], schema=new)

    live = raster.table.where(F.expr("position(X'01', pit) > 0"))
    around = with_strips(raster.with_table(raster.table.select(*KEY, "height", "width", "z")), ("z",), radius).join(shuffled(live.select(*KEY, "pit")), KEY)
    # windows are dealt out anew, so that no task has all batches of a tile
    return around.mapInArrow(deal, _BATCH).repartition(F.xxhash64("y", "x", "pits")).mapInArrow(search, _NEW)


def raster_least_cost(raster: Raster, radius: int, batch: int = BATCH) -> Raster:
    """The layers there and z of a raster (there, z, pit), whose pits are joined with lower ground."""
    types, size = raster.types(), raster.size
    lower = raster_paths(raster, radius, batch).groupBy("row", "col").agg(F.min("new_z").alias("new_z"))

    def run(t: dict) -> dict:
        import numpy as np

        z = layer(t, "z", types).copy()
        if t["given"]:
            rows, cols, new = (np.array([g[c] for g in t["given"]]) for c in ("row", "col", "new_z"))
            at = rows - t["tile_row"] * size, cols - t["tile_col"] * size
            z[at] = np.where(np.isnan(z[at]), np.nan, np.fmin(z[at], new.astype(z.dtype)))
        return kept("there")(t) | {"z": z.tobytes()}

    table = raster.table.select(*KEY, "height", "width", "there", "z").join(shuffled(by_tile(lower, size, "new_z")), KEY, "left")
    return Raster(each(table, run, f"{FRAME}, there binary, z binary"), size, raster.z, ("there", "z"))


def breach_paths_least_cost(cells: DataFrame, nodata: float = -9999.0, radius: int = DEFAULT_SEARCH_RADIUS, chunk_size: int | None = None, max_pits: int = DEFAULT_MAX_PITS, tile: int = TILE, nodata_outlet: str = "parity", pits_first: bool = True) -> DataFrame:
    """row, col, z: cells after single-cell pits, then all pits left, are breached.

    pits_first=False breaches the pits of cells (row, col, z, pit) as they are given.
    chunk_size is that of the single-cell pits. max_pits, a batch size elsewhere, changes
    nothing here: tasks do its work.
    """
    return to_cells(breached(cells, nodata, radius, chunk_size, tile, nodata_outlet, pits_first), "z")


def breached(cells: DataFrame, nodata: float, radius: int, chunk_size: int | None = None, tile: int = TILE, nodata_outlet: str = "parity", pits_first: bool = True) -> Raster:
    """As breach_paths_least_cost, a raster (there, z)."""
    if isinstance(radius, bool) or not isinstance(radius, int) or radius <= 0:
        raise ValueError("the search radius must be a positive integer")
    size = max(tile, radius)
    if pits_first:
        first = breached_pits(cells, nodata, chunk_size, nodata_outlet, size)
        if first.size < radius:  # tiles of small chunks
            first = to_raster(to_cells(first, "z", "pit"), size, ("z", "pit"))
    else:
        first = to_raster(cells.select("row", "col", F.col("z").cast("float").alias("z"), "pit"), size, ("z", "pit"))
    return raster_least_cost(first.with_table(written_tiles(first.table, "single-cell")), radius)
