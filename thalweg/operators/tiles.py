"""Tiles of a raster as rows that hold their cells as arrays, for steps that follow paths from cell to cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions.d8 import NODATA, STEPS
from thalweg.operators.grid import tile_of

TILE = 512
#: The code of cells that a tile lacks.
MISSING = 10


def arrow_schema(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def each_tile(cells: DataFrame, size: int, run: Callable, schema: str) -> DataFrame:
    """run(tile_row, tile_col, rows as an Arrow table) -> a list of dicts (of schema), for each tile that has cells."""
    import pyarrow as pa

    arrow = arrow_schema(schema)

    def apply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(run(key[0].as_py(), key[1].as_py(), table), schema=arrow)

    tiled = cells.withColumns({"tile_row": tile_of(size, "row").cast("long"), "tile_col": tile_of(size, "col").cast("long")})
    return tiled.groupBy("tile_row", "tile_col").applyInArrow(apply, schema)


def place(table, tile_row: int, tile_col: int, size: int):
    """(rows, columns within the tile, its height and width as far as it has cells)."""
    rows, cols = (table.column(c).to_numpy() - t * size for c, t in (("row", tile_row), ("col", tile_col)))
    return rows, cols, int(rows.max()) + 1, int(cols.max()) + 1


def pointers(codes):
    """(flat index that each cell drains to, itself at an end; which cells leave the tile; rows and columns they drain to).

    codes: directions (height, width). A path ends at a flat's cell, and before nodata.
    """
    import numpy as np

    height, width = codes.shape
    down, right = (np.array([s[axis] for s in STEPS] + [0] * (MISSING - 7)) for axis in (0, 1))
    flat = codes.ravel().astype("i8")
    here = np.arange(flat.size)
    to_row, to_col = here // width + down[flat], here % width + right[flat]
    moves = flat < 8
    inside = (to_row >= 0) & (to_row < height) & (to_col >= 0) & (to_col < width)
    to = np.where(inside, to_row * width + to_col, here)
    out = moves & (~inside | (flat[to] == MISSING))
    return np.where(moves & ~out & (flat[to] < NODATA), to, here), out, to_row, to_col


def path_sums(to, weights):
    """(last cell of each cell's path, sum of weights of the cells whose paths lead through it); None if paths run in a cycle.

    Pointers double: in each round a cell hands its sum to the cell it points at, and takes that one's pointer.
    """
    import numpy as np

    root, total, done = to, weights.copy(), to == np.arange(to.size)
    for _ in range(to.size.bit_length() + 2):
        if done.all():
            return root, total
        moving = np.flatnonzero(~done)
        total += np.bincount(root[moving], total[moving], to.size).astype("i8")
        root, done = np.where(done, root, root[root]), done | done[root]
    return None


def loops(to):
    """(cells whose paths lead back to them, the least cell of each one's cycle)."""
    import numpy as np

    far, rounds = to, to.size.bit_length() + 1
    for _ in range(rounds):
        far = far[far]
    on = np.unique(far[to[far] != far])
    least, ahead = np.arange(to.size), to
    for _ in range(rounds):
        least[on], ahead = np.minimum(least[on], least[ahead[on]]), ahead[ahead]
    return on, least[on]


def rim(height: int, width: int):
    """Flat indices of the cells on a tile's border."""
    import numpy as np

    at = np.arange(height * width)
    row, col = at // width, at % width
    return at[(row == 0) | (row == height - 1) | (col == 0) | (col == width - 1)]


def by_tile(rows: DataFrame, size: int, *columns: str, name: str = "given") -> DataFrame:
    """tile_row, tile_col, and a list of rows (row, col, columns): for rows of tiles' borders, whose number a tile bounds."""
    return rows.groupBy(tile_of(size, "row").cast("long").alias("tile_row"), tile_of(size, "col").cast("long").alias("tile_col")).agg(F.collect_list(F.struct("row", "col", *columns)).alias(name))
