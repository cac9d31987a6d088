"""Flow direction: each cell drains to the neighbour of steepest descent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.d8 import DISTANCES, NODATA, STEPS, UNDEFINED
from thalweg.operators.grid import best_code, neighbours
from thalweg.operators.raster import Raster, each, kept, layer, padded, shifted, with_strips
from thalweg.operators.tiles import MISSING


def slope(z: Column, neighbour: Column, code: int) -> Column:
    """Descent to a neighbour over its distance; infinite towards nodata and the outside.

    The difference is taken in the elevation's type, the division in double precision.
    """
    zn = neighbour["z"]
    return F.when(zn.isNull(), F.lit(float("inf"))).otherwise((z - zn).cast("double") / F.lit(DISTANCES[code]))


def neighbour_slopes(cells: DataFrame) -> DataFrame:
    """row, col, code, slope: one row for each neighbour of each cell that has data."""
    near = neighbours(cells, "z").where(F.col("z").isNotNull())
    each = F.array(*(F.struct(F.lit(k).alias("code"), slope(F.col("z"), F.col("near")[k], k).alias("slope")) for k in range(len(STEPS))))
    return near.select("row", "col", F.explode(each).alias("_s")).select("row", "col", "_s.code", "_s.slope")


def flow_direction(cells: DataFrame) -> DataFrame:
    """row, col, fdr: the first code of the steepest descent; 8 where there is none, 9 for nodata."""
    best = best_code(lambda n, k: F.when(slope(F.col("z"), n, k) > 0, slope(F.col("z"), n, k)))
    fdr = F.when(F.col("z").isNull(), NODATA).otherwise(F.coalesce(best, F.lit(UNDEFINED)))
    return neighbours(cells, "z").select("row", "col", fdr.cast("short").alias("fdr"))


def raster_directions(raster: Raster) -> Raster:
    """raster with the layer fdr, as flow_direction of its cells."""
    types, size = raster.types(), raster.size
    own = kept(*raster.layers)

    def run(t: dict) -> dict:
        import numpy as np

        wide = padded(t, "z", types, size)
        z = wide[1:-1, 1:-1]
        best, fdr = np.zeros(z.shape), np.full(z.shape, UNDEFINED, "i1")
        for k, distance in enumerate(DISTANCES):
            near = shifted(wide, k)
            with np.errstate(invalid="ignore"):
                fall = np.where(np.isnan(near), np.inf, (z - near).astype("f8") / distance)
            steeper = fall > best
            best[steeper], fdr[steeper] = fall[steeper], k
        fdr[np.isnan(z)] = NODATA
        fdr[~layer(t, "there", types)] = MISSING
        return own(t) | {"fdr": fdr.tobytes()}

    schema = ", ".join(["tile_row long, tile_col long, height int, width int", *(f"{c} binary" for c in (*raster.layers, "fdr"))])
    return raster.with_table(each(with_strips(raster, ("z",)), run, schema), "fdr")
