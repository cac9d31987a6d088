"""Drainage over flats: labels, increments away from higher and towards lower terrain.

A flat's cells (direction 8) get a mask that falls towards the flat's outlets and away
from the terrain above it; directions follow the mask's descent. Each tile finds its
level parts, and pairs of cells across borders join them to flats; distances spread breadth
first within tiles, and go on from tile to tile in rounds, as many as tiles that a
shortest path crosses. In a round only the tiles that are offered distances by a
neighbour's border are read, and only those are written where an offer was less than
what they had; all others stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from thalweg.functions.d8 import DISTANCES, NODATA, STEPS, UNDEFINED
from thalweg.operators.components import components
from thalweg.operators.grid import neighbours, shuffled, tile_of
from thalweg.operators.raster import FRAME, KEY, Raster, each, kept, layer, padded, shifted, to_cells, to_raster, with_strips
from thalweg.operators.tiles import MISSING, TILE, by_tile, each_tile, place, rim
from thalweg.session import discard, written, written_tiles


def _cells(dem: DataFrame, fdr: DataFrame) -> DataFrame:
    return dem.select("row", "col", "z").join(shuffled(fdr.select("row", "col", "fdr")), ["row", "col"])


def _kinds(cells: DataFrame) -> DataFrame:
    """cells (row, col, z, fdr) with kind: that of flat_edges, else null."""
    near = neighbours(cells, "z", "fdr")
    has = lambda test: F.exists("near", lambda n: n.isNotNull() & (n["fdr"] != NODATA) & test(n))
    low = (F.col("fdr") < UNDEFINED) & has(lambda n: (n["fdr"] == UNDEFINED) & (n["z"] == F.col("z")))
    high = (F.col("fdr") == UNDEFINED) & has(lambda n: n["z"] > F.col("z"))
    return near.select("row", "col", "z", "fdr", F.when(low, "low").when(high, "high").alias("kind"))


def flat_edges(dem: DataFrame, fdr: DataFrame) -> DataFrame:
    """row, col, kind: 'low' for cells that drain and lie level with a flat's cell, 'high' for a flat's cells below others."""
    return _kinds(_cells(dem, fdr)).where("kind is not null").select("row", "col", "kind")


_CELL = "row: bigint, col: bigint"
_LEVELS = f"{FRAME}, fdr binary, kind binary, part binary, rims array<struct<{_CELL}, z: double, part: bigint>>, parts array<struct<part: bigint, low: struct<{_CELL}>>>"
_FOUND = f"away binary, low binary, changed array<struct<{_CELL}, label: bigint, away: int, low: int>>, tops array<struct<label: bigint, away: int>>"
_STATE = f"{FRAME}, fdr binary, label binary, {_FOUND}"
_STEP = f"tile_row long, tile_col long, {_FOUND}"
#: Rounds whose tables are kept apart; then the tiles' last states are put together.
ROUNDS_APART = 8
#: Codes of the half of the directions that sees each pair of neighbours once.
HALF = (0, 5, 6, 7)
_LOW, _HIGH = 1, 2


def level_parts(z, there):
    """The least flat index of the cells of equal elevation that each cell is connected with; -1 where there is none."""
    import numpy as np

    height, width = z.shape
    at = np.arange(z.size).reshape(z.shape)
    ones, others = [], []
    for code in HALF:
        dr, dc = STEPS[code]
        one = (slice(0, height - dr), slice(max(0, -dc), width - max(0, dc)))
        other = (slice(dr, height), slice(max(0, dc), width + min(0, dc)))
        level = (z[one] == z[other]) & there[one] & there[other]
        ones.append(at[one][level])
        others.append(at[other][level])
    a, b, part = np.concatenate(ones), np.concatenate(others), at.ravel().copy()
    while len(a):
        x, y = part[a], part[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(part, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = part[part]
            if np.array_equal(further, part):
                break
            part = further
    return np.where(there.ravel(), part, -1)


def _level_tile(tile_row: int, tile_col: int, z, there, fdr, kind, size: int) -> dict:
    import numpy as np

    height, width = z.shape
    part = level_parts(z, there)
    y, x = tile_row * size, tile_col * size
    name = lambda k: ((int(k) // width + y) << 32) | (int(k) % width + x)
    border = [k for k in rim(height, width).tolist() if part[k] >= 0]
    low: dict[int, dict | None] = {int(part[k]): None for k in border}
    for k in np.flatnonzero((kind.ravel() == _LOW) & (part >= 0))[::-1].tolist():
        low[int(part[k])] = {"row": k // width + y, "col": k % width + x}
    rims = [{"row": k // width + y, "col": k % width + x, "z": float(z.ravel()[k]), "part": name(part[k])} for k in border]
    return {"tile_row": tile_row, "tile_col": tile_col, "height": height, "width": width, "fdr": fdr.tobytes(), "kind": kind.tobytes(), "part": part.astype("i4").tobytes(), "rims": rims, "parts": [{"part": name(k), "low": v} for k, v in low.items()]}


def _level_tiles(cells: DataFrame, size: int) -> DataFrame:
    """A row for each tile of cells (row, col, z, fdr, kind), with the level parts of the tile."""

    def run(tile_row: int, tile_col: int, table) -> list[dict]:
        import numpy as np

        rows, cols, height, width = place(table, tile_row, tile_col, size)
        there, fdr, kind = np.zeros((height, width), bool), np.full((height, width), MISSING, "i1"), np.zeros((height, width), "i1")
        fdr[rows, cols] = table.column("fdr").to_numpy(zero_copy_only=False)
        kind[rows, cols] = [{"low": _LOW, "high": _HIGH}.get(k, 0) for k in table.column("kind").to_pylist()]
        there[rows, cols] = table.column("z").is_valid().to_numpy(zero_copy_only=False)
        values = table.column("z").fill_null(0).to_numpy()
        z = np.zeros((height, width), values.dtype)
        z[rows, cols] = values
        return [_level_tile(tile_row, tile_col, z, there, fdr, kind, size)]

    return written(each_tile(cells.select("row", "col", "z", "fdr", "kind"), size, run, _LEVELS), "level-tiles")


def _raster_levels(raster: Raster) -> DataFrame:
    """As _level_tiles, of a raster (z, fdr), whose edges are seen with the strips of neighbours."""
    types, size = raster.types(), raster.size

    def run(t: dict) -> dict:
        import numpy as np

        wide, codes = padded(t, "z", types, size), padded(t, "fdr", types, size)
        z, fdr = wide[1:-1, 1:-1], codes[1:-1, 1:-1]
        low, high = np.zeros(z.shape, bool), np.zeros(z.shape, bool)
        for k in range(len(STEPS)):
            zn, code = shifted(wide, k), shifted(codes, k)
            low |= (code == UNDEFINED) & (zn == z)
            high |= (code != NODATA) & (zn > z)
        kind = np.where((fdr < UNDEFINED) & low, _LOW, np.where((fdr == UNDEFINED) & high, _HIGH, 0)).astype("i1")
        return _level_tile(t["tile_row"], t["tile_col"], z, ~np.isnan(z), fdr, kind, size)

    return written_tiles(each(with_strips(raster, ("z", "fdr")), run, _LEVELS), "level-tiles")


def _beyond(rims: DataFrame, size: int, codes=range(len(STEPS))) -> DataFrame:
    """rims with to_row, to_col: each of its neighbours in other tiles."""
    steps = F.explode(F.array(*(F.struct((F.col("row") + STEPS[k][0]).alias("row"), (F.col("col") + STEPS[k][1]).alias("col")) for k in codes)))
    found = rims.withColumn("to", steps).withColumns({"to_row": F.col("to.row"), "to_col": F.col("to.col")}).drop("to")
    return found.where((tile_of(size, "to_row") != tile_of(size, "row")) | (tile_of(size, "to_col") != tile_of(size, "col")))


def _labels(tiles: DataFrame, size: int) -> DataFrame:
    """tile_row, tile_col, labels: those of the parts of tiles that belong to a flat with an outlet, from 1 by first low edge."""
    rims = tiles.select(F.inline("rims"))
    other = rims.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("z").alias("to_z"), F.col("part").alias("b"))
    across = _beyond(rims, size, HALF).join(shuffled(other), ["to_row", "to_col"]).where("z = to_z").select(F.col("part").alias("a"), "b")
    named = components(across).withColumnRenamed("node", "part")
    parts = tiles.select("tile_row", "tile_col", F.inline("parts")).join(shuffled(named), "part", "left").withColumn("component", F.coalesce("component", "part"))
    parts = written(parts, "parts")
    firsts = parts.where("low is not null").groupBy("component").agg(F.min("low").alias("first"))
    # flats are numbered within rows of the raster, and rows by their numbers of flats: one for each row
    in_rows = firsts.groupBy(F.col("first.row").alias("row")).agg(F.count("*").alias("n"))
    before = in_rows.select("row", (F.sum("n").over(Window.orderBy("row")) - F.col("n")).alias("before"))
    ranked = firsts.withColumn("row", F.col("first.row")).withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("first.col"))).join(shuffled(before), "row")
    labelled = parts.join(shuffled(ranked.select("component", (F.col("before") + F.col("rank")).alias("label"))), "component")
    return labelled.groupBy("tile_row", "tile_col").agg(F.collect_list(F.struct("part", "label")).alias("labels"))


def _label_array(t: dict, size: int):
    """Labels of a tile's cells, 0 where there is none."""
    import numpy as np

    part = np.frombuffer(t["part"], "i4")
    label = np.zeros(part.size + 1, "i8")  # the last is that of no part
    for x in t["labels"] or ():
        label[((x["part"] >> 32) - t["tile_row"] * size) * t["width"] + (x["part"] & 0xFFFFFFFF) - t["tile_col"] * size] = x["label"]
    return label[part]


def flat_labels(dem: DataFrame, edges: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, label: cells of equal elevation that a low edge belongs to; labels from 1 by first low edge, row by row."""
    cells = dem.select("row", "col", "z").join(shuffled(edges.select("row", "col", "kind")), ["row", "col"], "left").withColumn("fdr", F.lit(0).cast("short"))
    tiles = _level_tiles(cells, tile)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for t in b.to_pylist():
                label = _label_array(t, tile)
                at = np.flatnonzero(label)
                yield pa.RecordBatch.from_arrays([pa.array(at // t["width"] + t["tile_row"] * tile), pa.array(at % t["width"] + t["tile_col"] * tile), pa.array(label[at])], ["row", "col", "label"])

    found = tiles.select("tile_row", "tile_col", "width", "part").join(shuffled(_labels(tiles, tile)), ["tile_row", "tile_col"])
    return found.mapInArrow(run, "row long, col long, label long").withColumn("label", F.col("label").cast("int"))


def spread(distance, label, passable, begin) -> None:
    """Breadth first, in place: cells that a step from begin or from one reached leads to get a distance 1 more, if that is less.

    A step leads to a passable neighbour of the same label. 0: not reached.
    """
    import numpy as np

    height, width = label.shape
    flat_label, flat_pass = label.ravel(), passable.ravel()
    levels = {int(d): begin[distance[begin] == d] for d in np.unique(distance[begin])}
    while levels:
        d = min(levels)
        here = levels.pop(d)
        here = here[distance[here] == d]
        row, col, new = here // width, here % width, []
        for dr, dc in STEPS:
            inside = (row + dr >= 0) & (row + dr < height) & (col + dc >= 0) & (col + dc < width)
            to = here[inside] + dr * width + dc
            to = to[flat_pass[to] & (flat_label[to] == flat_label[here[inside]]) & ((distance[to] == 0) | (distance[to] > d + 1))]
            distance[to] = d + 1
            new.append(to)
        new = np.unique(np.concatenate(new))
        if len(new):
            levels[d + 1] = np.concatenate([levels[d + 1], new]) if d + 1 in levels else new


def _stepper(size: int):
    """Tiles' states from their parts and labels, or from states and what borders offer: distances spread within each tile.

    Nothing for a tile where no offer is less. changed: the border's cells with new distances.
    """

    def run(t: dict) -> dict | None:
        import numpy as np

        height, width, y, x = t["height"], t["width"], t["tile_row"] * size, t["tile_col"] * size
        fdr, border = np.frombuffer(t["fdr"], "i1"), rim(height, width)
        out = {"tile_row": t["tile_row"], "tile_col": t["tile_col"]}
        if "part" in t:
            label, kind = _label_array(t, size), np.frombuffer(t["kind"], "i1")
            distances = [((kind == k) & (label > 0)).astype("i4") for k in (_HIGH, _LOW)]
            begins, before = [np.flatnonzero(d) for d in distances], [0, 0]
            out |= kept("fdr")(t) | {"label": label.astype("i8").tobytes()}
        else:
            label = np.frombuffer(t["label"], "i8")
            distances, begins = [np.frombuffer(t[c], "i4").copy() for c in ("away", "low")], [[], []]
            before = [d[border] for d in distances]
            for g in t["given"]:
                r, c = g["row"] - y, g["col"] - x
                k = r * width + c
                if r >= height or c >= width or label[k] != g["label"] or fdr[k] != UNDEFINED:
                    continue
                for d, new, begin in zip(distances, (g["away"], g["low"]), begins, strict=True):
                    if new and (d[k] == 0 or d[k] > new):
                        d[k] = new
                        begin.append(k)
            if not any(begins):
                return None
            begins = [np.array(begin, "i8") for begin in begins]
        for d, begin in zip(distances, begins, strict=True):
            if len(begin):
                spread(d, label.reshape(height, width), (fdr == UNDEFINED).reshape(height, width), begin)
        away, low = distances
        new = border[(label[border] > 0) & ((away[border] != before[0]) | (low[border] != before[1]))].tolist()
        changed = [{"row": k // width + y, "col": k % width + x, "label": int(label[k]), "away": int(away[k]), "low": int(low[k])} for k in new]
        names, first = np.unique(label, return_inverse=True)
        top = np.zeros(len(names), "i4")
        np.maximum.at(top, first, away)
        tops = [{"label": int(n), "away": int(m)} for n, m in zip(names, top, strict=True) if n]
        return out | {"away": away.tobytes(), "low": low.tobytes(), "changed": changed, "tops": tops}

    return run


def _last(rounds: list[DataFrame]) -> DataFrame:
    """tile_row, tile_col, new (away, low, tops): the last state of each tile of some rounds."""
    every = reduce(DataFrame.unionByName, (r.select(*KEY, F.lit(k).alias("_round"), F.struct("away", "low", "tops").alias("_new")) for k, r in enumerate(rounds)))
    return every.groupBy(*KEY).agg(F.max_by("_new", "_round").alias("new"))


def _newest(first: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """first with away, low and tops as they are after the rounds."""
    if not rounds:
        return first
    found = first.join(shuffled(_last(rounds)), KEY, "left")
    return found.withColumns({c: F.coalesce(f"new.{c}", c) for c in ("away", "low", "tops")}).drop("new")


def raster_flats(raster: Raster) -> Raster:
    """The layers there, fdr, label, away, low and mask of a raster (z, fdr), as flat_mask of its cells."""
    size = raster.size
    tiles = _raster_levels(raster)
    begin = each(tiles.drop("rims", "parts").join(shuffled(_labels(tiles, size)), KEY, "left"), _stepper(size), _STATE)
    first = written_tiles(begin, "flats-0")
    discard(tiles)
    latest, rounds, k = first, [], 0
    more = lambda c: F.when(F.col(c) > 0, F.col(c) + 1).alias(c)
    while True:
        k += 1
        offers = _beyond(latest.select(F.inline("changed")), size).select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), "label", more("away"), more("low"))
        offered = first.select(*KEY, "height", "width", "fdr", "label", "away", "low", "tops").join(shuffled(by_tile(offers, size, "label", "away", "low")), KEY)
        latest = written_tiles(each(_newest(offered, rounds).drop("tops"), _stepper(size), _STEP), f"flats-{k}")
        if not latest.take(1):
            discard(latest)
            break
        rounds.append(latest)
        if len(rounds) > ROUNDS_APART:
            whole = written_tiles(_last(rounds).select(*KEY, "new.*"), f"flats-to-{k}")
            discard(*rounds[:-1])
            rounds = [whole]
    state = _newest(first, rounds)
    tops = state.select(*KEY, F.inline("tops"))
    heights = tops.groupBy("label").agg(F.max("away").alias("height"))
    given = tops.select(*KEY, "label").join(shuffled(heights), "label").groupBy(*KEY).agg(F.collect_list(F.struct("label", "height")).alias("heights"))

    def run(t: dict) -> dict:
        import numpy as np

        there = np.frombuffer(t["fdr"], "i1") != MISSING
        label, away, low = np.frombuffer(t["label"], "i8"), np.frombuffer(t["away"], "i4"), np.frombuffer(t["low"], "i4")
        known = sorted((h["label"], h["height"]) for h in t["heights"] or ())
        names, tall = (np.array([0, *(h[i] for h in known)]) for i in (0, 1))
        height = tall[np.searchsorted(names, label)]
        mask = np.where(low > 0, 2 * low + np.where(away > 0, height - away, 0), -away).astype("i4")
        return kept("fdr", "away", "low")(t) | {"there": there.tobytes(), "label": np.where(there, label, -1).tobytes(), "mask": mask.tobytes()}

    layers = ("there", "fdr", "label", "away", "low", "mask")
    table = each(state.drop("changed", "tops").join(shuffled(given), KEY, "left"), run, ", ".join([FRAME, *(f"{c} binary" for c in layers)]))
    return Raster(table, size, raster.z, layers)


def flat_mask(dem: DataFrame, fdr: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, label, away, low, flat_mask of all cells; zeros outside of flats that drain.

    away and low: 1 and the steps from the terrain above and from the outlets, through the
    flat's cells; flat_mask: 2 low + (the flat's largest away - away). The tile's size changes nothing.
    """
    raster = to_raster(_cells(dem, fdr), tile, ("z", "fdr"))
    found = raster_flats(raster.with_table(written(raster.table, "raster")))
    return to_cells(found, "label", "away", "low", "mask").withColumnRenamed("mask", "flat_mask")


def flat_report(mask: DataFrame, fdr: DataFrame) -> DataFrame:
    """drainable, undrainable: numbers of flats' cells with and without an outlet."""
    flat = fdr.where(F.col("fdr") == UNDEFINED).join(shuffled(mask), ["row", "col"])
    return flat.agg(F.count(F.when(F.col("label") > 0, 1)).alias("drainable"), F.count(F.when(F.col("label") == 0, 1)).alias("undrainable"))


def flat_flow_direction(mask: DataFrame, fdr: DataFrame, strict: bool = True, tile: int = TILE) -> DataFrame:
    """row, col, fdr with the directions of flats' cells: to the neighbour of the same label with the steepest fall of the mask.

    strict: a cell without an outlet, or where no mask falls, keeps 8. Otherwise it takes
    the first neighbour with the least slope, upwards too, which may run in a cycle.
    """
    cells = fdr.select("row", "col", "fdr").join(shuffled(mask.select("row", "col", "label", F.col("flat_mask").alias("mask"))), ["row", "col"])
    raster = to_raster(cells, tile, ("fdr", "label", "mask"))
    return to_cells(raster_drained(raster.with_table(written(raster.table, "raster")), strict), "fdr")


def raster_drained(raster: Raster, strict: bool = True) -> Raster:
    """raster (fdr, label, mask) with the directions of flat_flow_direction for its own."""
    types, size = raster.types(), raster.size
    own = kept(*(c for c in raster.layers if c != "fdr"))

    def run(t: dict) -> dict:
        import numpy as np

        labels, masks = padded(t, "label", types, size), padded(t, "mask", types, size)
        label, mask, fdr = labels[1:-1, 1:-1], masks[1:-1, 1:-1], layer(t, "fdr", types).copy()
        best, code = np.full(label.shape, 0.0 if strict else -np.inf), np.full(label.shape, UNDEFINED, "i1")
        for k, distance in enumerate(DISTANCES):
            drop = (mask - shifted(masks, k)).astype("f8") / distance
            steeper = (shifted(labels, k) == label) & (drop > best)
            if strict:
                steeper &= label > 0
            best[steeper], code[steeper] = drop[steeper], k
        flat = fdr == UNDEFINED
        fdr[flat] = code[flat]
        return own(t) | {"fdr": fdr.tobytes()}

    schema = ", ".join([FRAME, *(f"{c} binary" for c in raster.layers if c != "fdr"), "fdr binary"])
    return raster.with_table(each(with_strips(raster, ("label", "mask")), run, schema))
