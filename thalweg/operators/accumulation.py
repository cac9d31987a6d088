"""Flow accumulation and perimeter links, tile by tile.

Each tile sums up its own cells along their paths, and tells of every cell on its border
where its path leaves the tile. The cells where paths leave are a small graph: each
leads to the next tile's. Along it counts are handed on by pointer doubling, so that a
path across n tiles takes log2(n) rounds of joins. What flows into a tile's border is then added
to its own sums. Cells are shuffled once; rounds see cells of borders only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.d8 import ACCUMULATION_NODATA, EXTERNAL, NODATA, TERMINATES, step
from thalweg.operators.grid import shuffled
from thalweg.operators.raster import FRAME, KEY, Raster, each, kept, layer
from thalweg.operators.tiles import MISSING, TILE, arrow_schema, by_tile, each_tile, loops, path_sums, place, pointers, rim
from thalweg.session import discard, written


def downstream(fdr: DataFrame) -> DataFrame:
    """row, col, fdr, to_row, to_col: the cell each drains to, null if it doesn't flow on."""
    return fdr.select("row", "col", "fdr", (F.col("row") + step(F.col("fdr"), 0)).alias("to_row"), (F.col("col") + step(F.col("fdr"), 1)).alias("to_col"))


def edges(fdr: DataFrame) -> DataFrame:
    """row, col, fdr, to_row, to_col, to_fdr: as downstream, with the direction of the next cell.

    to_fdr is null outside the raster.
    """
    ends = fdr.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("fdr").alias("to_fdr"))
    return downstream(fdr).join(shuffled(ends), ["to_row", "to_col"], "left").select("row", "col", "fdr", "to_row", "to_col", "to_fdr")


def inflow_count(fdr: DataFrame) -> DataFrame:
    """row, col, inflow: how many neighbours drain into a cell; null for nodata cells."""
    into = downstream(fdr).where("to_row is not null and fdr <> 9").groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.count("*").alias("n"))
    return fdr.join(shuffled(into), ["row", "col"], "left").select("row", "col", F.when(F.col("fdr") != NODATA, F.coalesce("n", F.lit(0))).alias("inflow"))


def perimeter(height: int, width: int, row: str = "row", col: str = "col") -> Column:
    """Whether a cell lies on the border of its raster."""
    return F.col(row).isin(0, height - 1) | F.col(col).isin(0, width - 1)


def _doubled(start: DataFrame, sums: bool) -> DataFrame:
    """node, root (last node of the path), n (the sum of n upstream and its own) of start (node, next, n)."""
    state = written(start.select("node", F.coalesce("next", "node").alias("root"), F.col("next").isNull().alias("done"), "n"), "pointers")
    for k in range(state.count().bit_length() + 2):  # no path is longer than the nodes
        moving = state.where("not done")
        if not moving.take(1):
            return state.drop("done")
        ahead = state.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("done").alias("_done"))
        # only nodes still on their way are joined
        new = moving.join(shuffled(ahead), "root").select("node", F.col("_root").alias("root"), F.col("_done").alias("done"), "n").unionByName(state.where("done"))
        if sums:
            gifts = moving.groupBy(F.col("root").alias("node")).agg(F.sum("n").alias("_n"))
            new = new.join(shuffled(gifts), "node", "left").select("node", "root", "done", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        before, state = state, written(new, f"pointers-{k}")
        discard(before)
    raise ValueError(f"flow directions run in a cycle through {tuple(state.where('not done').first()['root'])}; flow_cycles finds all")


_CELL = "row: bigint, col: bigint"
_TILES = f"tile_row long, tile_col long, height int, width int, codes binary, exits array<struct<{_CELL}, to_row: bigint, to_col: bigint, n: bigint>>, rims array<struct<{_CELL}, fdr: smallint, exit_row: bigint, exit_col: bigint>>, loops array<struct<{_CELL}, name_row: bigint, name_col: bigint>>"


def _tiles(fdr: DataFrame, size: int) -> DataFrame:
    """A row for each tile: its codes; the cells that drain out of it, where to, and their counts; those on its border and where their paths leave it."""

    def run(tile_row: int, tile_col: int, table) -> list[dict]:
        import numpy as np

        rows, cols, height, width = place(table, tile_row, tile_col, size)
        codes = np.full((height, width), MISSING, "i1")
        codes[rows, cols] = table.column("fdr").to_numpy()
        return [_tile(tile_row, tile_col, codes, size)]

    return each_tile(fdr.select("row", "col", "fdr"), size, run, _TILES)


def _tile(tile_row: int, tile_col: int, codes, size: int) -> dict:
    import numpy as np

    height, width = codes.shape
    y, x = tile_row * size, tile_col * size
    to, out, to_row, to_col = pointers(codes)
    found, circles = path_sums(to, np.ones(to.size, "i8")), []
    if found is None:
        on, least = loops(to)
        circles = [dict(row=int(k // width + y), col=int(k % width + x), name_row=int(n // width + y), name_col=int(n % width + x)) for k, n in zip(on, least, strict=True)]
        to[on] = on  # paths end where they meet a cycle
        found = path_sums(to, np.ones(to.size, "i8"))
    root, n = found
    exits, border = np.flatnonzero(out), rim(height, width)
    border = border[codes.ravel()[border] != MISSING]
    leaves = out[root[border]]
    return {
        "tile_row": tile_row, "tile_col": tile_col, "height": height, "width": width, "codes": codes.tobytes(), "loops": circles,
        "exits": [dict(row=int(k // width + y), col=int(k % width + x), to_row=int(to_row[k] + y), to_col=int(to_col[k] + x), n=int(n[k])) for k in exits],
        "rims": [dict(row=int(k // width + y), col=int(k % width + x), fdr=int(codes.ravel()[k]), exit_row=int(e // width + y) if has else None, exit_col=int(e % width + x) if has else None) for k, e, has in zip(border, root[border], leaves, strict=True)],
    }


def _acyclic(tiles: DataFrame) -> DataFrame:
    tiles = written(tiles, "tiles")
    for r in tiles.where("size(loops) > 0").select(F.col("loops")[0].alias("at")).take(1):
        raise ValueError(f"flow directions run in a cycle at row {r['at']['row']}, column {r['at']['col']}; flow_cycles finds all")
    return tiles


def _graph(tiles: DataFrame) -> DataFrame:
    """Cells where paths leave tiles: node, next (the one that its path leaves the next tile by), n, where it drains to, leaves (the raster)."""
    exits, rims = tiles.select(F.inline("exits")), tiles.select(F.inline("rims"))
    entries = rims.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("fdr").alias("to_fdr"), "exit_row", "exit_col")
    goes_on = F.col("to_fdr").isNotNull() & (F.col("to_fdr") != NODATA)
    on = exits.join(shuffled(entries), ["to_row", "to_col"], "left")
    following = F.when(goes_on & F.col("exit_row").isNotNull(), F.struct(F.col("exit_row").alias("row"), F.col("exit_col").alias("col")))
    return on.select(F.struct("row", "col").alias("node"), following.alias("next"), "n", "to_row", "to_col", goes_on.alias("goes_on"), F.col("to_fdr").isNull().alias("leaves"))


def flow_accumulation(fdr: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, fac: cells that drain through a cell, itself included; -9999 for nodata.

    Raises ValueError for directions that run in a cycle. The tile's size changes nothing.
    """
    tiles = _acyclic(_tiles(fdr, tile))
    return _summed(tiles.join(shuffled(_inflows(tiles, tile)), ["tile_row", "tile_col"], "left"), tile)


def raster_accumulation(raster: Raster) -> Raster:
    """raster (there, fdr) with the layer fac, as flow_accumulation of its cells; no other layers."""
    types, size = raster.types(), raster.size
    tiles = _acyclic(each(raster.table.select(*KEY, "height", "width", "fdr"), lambda t: _tile(t["tile_row"], t["tile_col"], layer(t, "fdr", types), size), _TILES))

    def run(t: dict) -> dict:
        import numpy as np

        codes = layer(t, "codes", {"codes": "i1"})
        return kept()(t) | {"there": (codes != MISSING).tobytes(), "fdr": t["codes"], "fac": np.where(codes.ravel() == MISSING, 0, _sums(t, codes, size)).tobytes()}

    summed = each(tiles.select(*KEY, "height", "width", "codes").join(shuffled(_inflows(tiles, size)), KEY, "left"), run, f"{FRAME}, there binary, fdr binary, fac binary")
    return Raster(summed, size, raster.z, ("there", "fdr", "fac"))


def _inflows(tiles: DataFrame, size: int) -> DataFrame:
    """tile_row, tile_col, given (row, col, n): what flows into the cells on a tile's border from other tiles."""
    graph = written(_graph(tiles), "exits")
    total = _doubled(graph, sums=True).select("node", F.col("n").alias("total"))
    into = graph.where("goes_on").join(shuffled(total), "node").groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("total").alias("n"))
    return by_tile(into, size, "n")


def _sums(t: dict, codes, size: int):
    """Cells that drain through each of a tile's; nodata has none."""
    import numpy as np

    y, x = t["tile_row"] * size, t["tile_col"] * size
    weights = np.ones(codes.size, "i8")
    for g in t["given"] or ():
        weights[(g["row"] - y) * t["width"] + g["col"] - x] += g["n"]
    _, n = path_sums(pointers(codes)[0], weights)
    return np.where(codes.ravel() == NODATA, ACCUMULATION_NODATA, n)


def tile_accumulation(fdr: DataFrame, tile: int = TILE) -> DataFrame:
    """As flow_accumulation, of each tile by itself."""
    nothing = F.lit(None).cast("array<struct<row: bigint, col: bigint, n: bigint>>")
    return _summed(_acyclic(_tiles(fdr, tile)).withColumn("given", nothing), tile)


def _summed(tiles: DataFrame, size: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for t in b.to_pylist():
                codes = np.frombuffer(t["codes"], "i1").reshape(t["height"], t["width"])
                there = np.flatnonzero(codes.ravel() != MISSING)
                yield pa.RecordBatch.from_arrays([pa.array(there // t["width"] + t["tile_row"] * size), pa.array(there % t["width"] + t["tile_col"] * size), pa.array(_sums(t, codes, size)[there])], ["row", "col", "fac"])

    return tiles.select("tile_row", "tile_col", "height", "width", "codes", "given").mapInArrow(run, "row long, col long, fac long")


def tile_links(fdr: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, link_row, link_col of the cells on the border of each tile, as flow_links of the tile by itself."""
    rims = _acyclic(_tiles(fdr, tile)).select(F.inline("rims"))
    itself = (F.col("exit_row") == F.col("row")) & (F.col("exit_col") == F.col("col"))
    link = lambda axis, name: F.when(itself, F.lit(EXTERNAL[axis])).otherwise(F.coalesce(f"exit_{name}", F.lit(TERMINATES[axis]))).cast("long")
    return rims.select("row", "col", link(0, "row").alias("link_row"), link(1, "col").alias("link_col"))


def flow_links(fdr: DataFrame, height: int, width: int, tile: int = TILE) -> DataFrame:
    """row, col, link_row, link_col of the cells on the border of a raster.

    (-2, -2): the cell itself drains out; (-1, -1): its path ends inside; else the cell
    where its path leaves.
    """
    tiles = _acyclic(_tiles(fdr, tile))
    graph = written(_graph(tiles), "exits")
    ends = graph.select(F.col("node").alias("root"), F.col("leaves").alias("root_leaves"))
    roots = _doubled(graph, sums=False).join(shuffled(ends), "root").join(shuffled(graph.select("node", "leaves")), "node")
    border = tiles.select(F.inline("rims")).where(perimeter(height, width)).withColumn("node", F.when(F.col("exit_row").isNotNull(), F.struct(F.col("exit_row").alias("row"), F.col("exit_col").alias("col"))))
    found = border.join(shuffled(roots.drop("n")), "node", "left")
    itself = F.col("leaves") & (F.col("node.row") == F.col("row")) & (F.col("node.col") == F.col("col"))

    def link(axis: int, name: str) -> Column:
        return F.when(itself, F.lit(EXTERNAL[axis])).when(F.col("root_leaves"), F.col(f"root.{name}")).otherwise(F.lit(TERMINATES[axis])).cast("long")

    return found.select("row", "col", link(0, "row").alias("link_row"), link(1, "col").alias("link_col"))


def flow_cycles(fdr: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, cycle_row, cycle_col, length: the cells whose paths lead back to them, with the least cell of their cycle and its number of cells.

    Tiles find their own cycles. In the graph of cells where paths leave tiles, what is
    still on its way after as many steps as there are nodes has run into a cycle, and
    stands on one; within the tiles that it crosses, its cells lie between entry and exit.
    """
    tiles = written(_tiles(fdr, tile), "tiles")
    inside = tiles.select(F.inline("loops")).select("row", "col", F.struct(F.col("name_row").alias("row"), F.col("name_col").alias("col")).alias("name"))
    graph = written(_graph(tiles), "exits")
    state = written(graph.where("next is not null").select("node", F.col("next").alias("root"), F.col("node").alias("least")), "circles")
    for k in range(state.count().bit_length() + 1):
        ahead = state.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("least").alias("_least"))
        # nodes whose paths end have none ahead
        before, state = state, written(state.join(shuffled(ahead), "root").select("node", F.col("_root").alias("root"), F.least("least", "_least").alias("least")), f"circles-{k}")
        discard(before)
    ring = state.join(shuffled(state.select(F.col("root").alias("node")).distinct()), "node").select("node", "least")
    entries = graph.join(shuffled(ring), "node").select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.col("least.row").alias("name_row"), F.col("least.col").alias("name_col"))
    cell = arrow_schema(_CROSSED)

    def cross(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for t in b.to_pylist():
                codes = np.frombuffer(t["codes"], "i1").reshape(t["height"], t["width"])
                to, y, x = pointers(codes)[0], t["tile_row"] * tile, t["tile_col"] * tile
                found = []
                for g in t["given"]:
                    at = (g["row"] - y) * t["width"] + g["col"] - x
                    while True:
                        found.append({"row": int(at // t["width"] + y), "col": int(at % t["width"] + x), "name_row": g["name_row"], "name_col": g["name_col"]})
                        if to[at] == at:
                            break
                        at = to[at]
                yield pa.RecordBatch.from_pylist(found, schema=cell)

    crossed = tiles.select(*KEY, "height", "width", "codes").join(shuffled(by_tile(entries, tile, "name_row", "name_col")), KEY).mapInArrow(cross, _CROSSED)
    every = written(inside.unionByName(crossed.select("row", "col", F.struct(F.col("name_row").alias("row"), F.col("name_col").alias("col")).alias("name"))), "cycles")
    named = every.groupBy("name").agg(F.min(F.struct("row", "col")).alias("cycle"), F.count("*").alias("length"))
    return every.join(shuffled(named), "name").select("row", "col", F.col("cycle.row").alias("cycle_row"), F.col("cycle.col").alias("cycle_col"), "length")


_CROSSED = "row long, col long, name_row long, name_col long"
