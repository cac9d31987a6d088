"""A raster as a table of array tiles: a row for each tile, with a binary column for each layer.

Cells are shuffled to their tiles once; from then on operators pass tiles. What a tile
sees of its neighbours are strips along its border, as wide as the operator's halo: each
tile sends up to eight of them, so between operators borders are exchanged and not cells.
A cell that the table of cells lacks is not there; like all outside the raster, it counts
as nodata.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions.d8 import STEPS
from thalweg.operators.grid import shuffled
from thalweg.operators.tiles import MISSING, TILE, arrow_schema, each_tile, place

KEY = ["tile_row", "tile_col"]
FRAME = "tile_row long, tile_col long, height int, width int"
#: Types of layers in arrays; elevations are single or double.
TYPES = {"there": "?", "fdr": "i1", "kind": "i1", "part": "i4", "label": "i8", "away": "i4", "low": "i4", "mask": "i4", "fac": "i8", "pit": "?"}
#: What a layer holds where there is no cell.
NOTHING = {"z": float("nan"), "there": False, "fdr": 9, "label": -1, "mask": 0, "pit": False}
#: Spark's types of layers as columns of cells, and their names.
COLUMNS = {"fdr": "short", "label": "int", "away": "int", "low": "int", "mask": "int", "fac": "long", "pit": "boolean"}


@dataclass
class Raster:
    """table: FRAME and a binary column for each layer; z is float or double."""

    table: DataFrame
    size: int
    z: str = "float"
    layers: tuple[str, ...] = ("there", "z")

    def with_table(self, table: DataFrame, *more: str) -> Raster:
        """The same with another table, which has more layers."""
        return replace(self, table=table, layers=(*self.layers, *more))

    def types(self) -> dict[str, str]:
        return TYPES | {"z": "f4" if self.z == "float" else "f8"}


def layer(t: dict, name: str, types: dict[str, str]):
    import numpy as np

    return np.frombuffer(t[name], types[name]).reshape(t["height"], t["width"])


def to_raster(cells: DataFrame, size: int = TILE, layers: tuple[str, ...] = ("z",)) -> Raster:
    """The tiles of cells (row, col, layers), which are shuffled once; null elevations are nodata, and null layers absent."""
    z = "float" if dict(cells.dtypes).get("z") == "float" else "double"
    made = Raster(cells, size, z, ("there", *layers))
    types = made.types()

    def run(tile_row: int, tile_col: int, table) -> list[dict]:
        import numpy as np

        rows, cols, height, width = place(table, tile_row, tile_col, size)
        out = {"tile_row": tile_row, "tile_col": tile_col, "height": height, "width": width}
        there = np.zeros((height, width), bool)
        there[rows, cols] = True
        out["there"] = there.tobytes()
        for name in layers:
            whole = np.full((height, width), MISSING if name == "fdr" else NOTHING[name], types[name])
            whole[rows, cols] = table.column(name).fill_null(NOTHING[name]).to_numpy(zero_copy_only=False)
            out[name] = whole.tobytes()
        return [out]

    own = cells.select("row", "col", *(F.col(c).cast(z if c == "z" else COLUMNS[c]).alias(c) for c in layers))
    return replace(made, table=each_tile(own, size, run, ", ".join([FRAME, *(f"{c} binary" for c in made.layers)])))


def each(table: DataFrame, run: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """run(tile as a dict) -> a dict of schema, or None, for each row of a table of tiles."""
    arrow = arrow_schema(schema)

    def apply(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):  # one tile is held at a time
                made = run(b.slice(k, 1).to_pylist()[0])
                if made is not None:
                    yield pa.RecordBatch.from_pylist([made], schema=arrow)

    return table.mapInArrow(apply, schema)


def kept(*columns: str) -> Callable[[dict], dict]:
    """Takes the frame of a tile, and further columns, as they are."""
    return lambda t: {c: t[c] for c in ("tile_row", "tile_col", "height", "width", *columns)}


def strips(raster: Raster, layers: tuple[str, ...], halo: int = 1) -> DataFrame:
    """tile_row, tile_col, near: for each tile the strips that its neighbours have along its border."""
    size, types = raster.size, raster.types()
    columns = "".join(f", {c} binary" for c in layers)
    schema = f"tile_row long, tile_col long, y long, x long, height int, width int{columns}"
    arrow = arrow_schema(schema)

    def part(step: int, length: int) -> slice:
        return slice(0, min(halo, length)) if step < 0 else slice(size - halo, length) if step > 0 else slice(0, length)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                t = b.slice(k, 1).to_pylist()[0]
                out = []
                for dr, dc in STEPS:
                    to_row, to_col = t["tile_row"] + dr, t["tile_col"] + dc
                    rows, cols = part(dr, t["height"]), part(dc, t["width"])
                    if to_row < 0 or to_col < 0 or rows.start >= rows.stop or cols.start >= cols.stop:
                        continue
                    strip = {"tile_row": to_row, "tile_col": to_col, "y": t["tile_row"] * size + rows.start, "x": t["tile_col"] * size + cols.start, "height": rows.stop - rows.start, "width": cols.stop - cols.start}
                    out.append(strip | {c: np.ascontiguousarray(layer(t, c, types)[rows, cols]).tobytes() for c in layers})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    sent = raster.table.select(*KEY, "height", "width", *layers).mapInArrow(run, schema)
    return sent.groupBy(*KEY).agg(F.collect_list(F.struct("y", "x", "height", "width", *layers)).alias("near"))


def with_strips(raster: Raster, layers: tuple[str, ...], halo: int = 1) -> DataFrame:
    """The table of a raster with near: what its neighbours have along the border."""
    return raster.table.join(shuffled(strips(raster, layers, halo)), KEY, "left")


def padded(t: dict, name: str, types: dict[str, str], size: int, halo: int = 1):
    """A tile's layer with a border of halo cells from its strips, or of nothing."""
    import numpy as np

    height, width = t["height"], t["width"]
    out = np.full((height + 2 * halo, width + 2 * halo), NOTHING[name], types[name])
    out[halo : halo + height, halo : halo + width] = layer(t, name, types)
    y, x = t["tile_row"] * size - halo, t["tile_col"] * size - halo
    for s in t["near"] or ():
        block = layer(s, name, types)
        r, c = s["y"] - y, s["x"] - x
        into = out[max(0, r) : r + s["height"], max(0, c) : c + s["width"]]
        into[:] = block[max(0, -r) :, max(0, -c) :][: into.shape[0], : into.shape[1]]
    return out


def shifted(array, code: int):
    """The neighbours in a direction, of an array with a border of one cell."""
    dr, dc = STEPS[code]
    height, width = array.shape
    return array[1 + dr : height - 1 + dr, 1 + dc : width - 1 + dc]


def to_cells(raster: Raster, *layers: str) -> DataFrame:
    """row, col and a column for each of the layers, of the cells that are there."""
    types, size, z = raster.types(), raster.size, raster.z
    kinds = COLUMNS | {"z": z}
    schema = ", ".join(["row long", "col long", *(f"{c} {kinds[c]}" for c in layers)])
    arrow = arrow_schema(schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                t = b.slice(k, 1).to_pylist()[0]
                at = np.flatnonzero(layer(t, "there", types))
                columns = [pa.array(at // t["width"] + t["tile_row"] * size), pa.array(at % t["width"] + t["tile_col"] * size)]
                for c in layers:
                    values = layer(t, c, types).ravel()[at]
                    columns.append(pa.array(values, mask=np.isnan(values)) if c == "z" else pa.array(values).cast(arrow.field(c).type))
                for a in range(0, len(at), 65536):
                    yield pa.RecordBatch.from_arrays([x.slice(a, 65536) for x in columns], schema=arrow)

    return raster.table.select(*KEY, "height", "width", "there", *(c for c in layers if c != "there")).mapInArrow(run, schema)
