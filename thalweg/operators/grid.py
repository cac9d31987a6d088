"""Cells, windows of cells, tiles with halos, and the eight neighbours of every cell.

A raster is a dense table of cells (row, col, values); nodata is null. Everything
outside the raster is nodata too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from thalweg.functions.d8 import STEPS

#: Edge of the tiles in which neighbours are found.
STENCIL_TILE = 512


#: Cells that a task holds on average while neighbours are found.
STENCIL_CELLS = 1 << 17


def shuffled(table: DataFrame) -> DataFrame:
    """table, for a join that shuffles both of its sides.

    Spark goes by the sizes of files, and a raster's files are so much smaller than its
    rows that it would broadcast whole rasters.
    """
    return table.hint("merge")


def normalise(cells: DataFrame, nodata: float | None = None, value: str = "z", kind: str = "float") -> DataFrame:
    """Nodata, taken in the value's own type, and NaN become null."""
    z = F.col(value).cast(kind)
    out = z.isNull() | F.isnan(z.cast("double"))
    if nodata is not None:
        out = out | (z == F.lit(nodata).cast(kind))
    return cells.withColumn(value, F.when(~out, z))


def extent(cells: DataFrame) -> tuple[int, int]:
    """(height, width) of a raster that begins at row 0, column 0."""
    height, width = cells.agg(F.max("row") + 1, F.max("col") + 1).first()
    return height or 0, width or 0


def grid(spark, row: int, col: int, height: int, width: int) -> DataFrame:
    """All coordinates of a window, as row and col."""
    if height < 0 or width < 0:
        raise ValueError("a window's size can't be negative")
    if not height or not width:
        return spark.createDataFrame([], "row long, col long")
    return spark.range(height * width).select((F.floor(F.col("id") / width) + row).alias("row"), (F.col("id") % width + col).alias("col"))


def window(cells: DataFrame, row: int, col: int, height: int, width: int, value: str = "z") -> DataFrame:
    """A window of exactly height x width cells; those outside the raster are nodata (null).

    The bounds are filters on row and col, so they reach the scan.
    """
    inside = cells.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1)).select("row", "col", value)
    return grid(cells.sparkSession, row, col, height, width).join(inside, ["row", "col"], "left")


def dense(cells: DataFrame, height: int, width: int, value: str = "z") -> DataFrame:
    """cells with a row, of null value, for each coordinate of the raster that has none."""
    return window(cells, 0, 0, height, width, value)


def tile_of(size: int, axis: str) -> Column:
    return F.floor(F.col(axis) / size)


def chunk_index(height: int, width: int, size: int, spark) -> DataFrame:
    """tile_row, tile_col, and the extent of each tile: y0, x0, h, w."""
    if size <= 0:
        raise ValueError("a tile's edge must be positive")
    down, across = -(-height // size), -(-width // size)
    return grid(spark, 0, 0, down, across).select(
        F.col("row").alias("tile_row"), F.col("col").alias("tile_col"), (F.col("row") * size).alias("y0"), (F.col("col") * size).alias("x0"), F.least(F.lit(size), height - F.col("row") * size).alias("h"), F.least(F.lit(size), width - F.col("col") * size).alias("w")
    )


def with_halo(cells: DataFrame, size: int, halo: int, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Each cell once for every tile whose extent, widened by halo, holds it: adds tile_row, tile_col.

    Only tiles that have a core cell of their own appear. bounds: the extent, if it is known.
    """
    height, width = bounds or extent(cells)

    def reach(axis: str, most: int) -> Column:
        first = F.greatest(F.floor((F.col(axis) - halo) / size), F.lit(0))
        return F.sequence(first, F.least(F.floor((F.col(axis) + halo) / size), F.lit((most - 1) // size)))

    return cells.withColumn("tile_row", F.explode(reach("row", height))).withColumn("tile_col", F.explode(reach("col", width)))


def core(tiled: DataFrame, size: int) -> DataFrame:
    """The rows of tiles less their halos."""
    return tiled.where((tile_of(size, "row") == F.col("tile_row")) & (tile_of(size, "col") == F.col("tile_col")))


def neighbours(cells: DataFrame, *values: str, size: int = STENCIL_TILE) -> DataFrame:
    """cells with `near`: an array of the 8 neighbours' (row, col, values), in code order.

    Values are null for nodata; coordinates that cells lack count as nodata, and cost a
    join with the grid. A neighbour outside the raster is null. Tiles with a halo of one
    cell are dealt out once; within them, two window passes over sorted cells, along rows
    and then along columns, reach all 8, with no join and no row for each pair.
    """
    values = values or ("z",)
    height, width, n = (x or 0 for x in cells.agg(F.max("row") + 1, F.max("col") + 1, F.count("*")).first())
    sparse = n < height * width
    if sparse:
        cells = grid(cells.sparkSession, 0, 0, height, width).join(shuffled(cells.withColumn("_there", F.lit(True))), ["row", "col"], "left")
    # the tasks are as many as the cells ask for: left to shuffled bytes, a task's sorts would grow with the raster
    tiles = -(-height // size) * -(-width // size)
    parts = max(1, -(-height * width // STENCIL_CELLS), min(tiles, cells.sparkSession.sparkContext.defaultParallelism))
    tiled = with_halo(cells, size, 1, (height, width)).repartition(parts, "tile_row", "tile_col")
    along = Window.partitionBy("tile_row", "tile_col", "row").orderBy("col")
    down = Window.partitionBy("tile_row", "tile_col", "col").orderBy("row")
    own = F.struct("row", "col", *values)
    three = F.struct(F.lag(own).over(along).alias("w"), own.alias("o"), F.lead(own).over(along).alias("e"))
    rows = tiled.withColumn("_three", three)
    rows = rows.withColumns({"_n": F.lag("_three").over(down), "_s": F.lead("_three").over(down)})
    at = {(dr, dc): f"{ {-1: '_n', 0: '_three', 1: '_s'}[dr] }.{ {-1: 'w', 0: 'o', 1: 'e'}[dc] }" for dr, dc in STEPS}
    rows = core(rows, size)
    if sparse:
        rows = rows.where("_there").drop("_there")
    return rows.withColumn("near", F.array(*(F.col(at[s]) for s in STEPS))).drop("_three", "_n", "_s", "tile_row", "tile_col")


def best_code(rank: Callable[[Column, int], Column]) -> Column:
    """The code of the neighbour with the largest rank, the first on ties; null if no rank is non-null.

    rank(neighbour, code): a column, null for neighbours that don't count.
    """
    each = [F.struct(rank(F.col("near")[k], k).alias("rank"), F.lit(-k).alias("code")) for k in range(len(STEPS))]
    found = F.array_max(F.filter(F.array(*each), lambda x: x["rank"].isNotNull()))
    return -found["code"]
