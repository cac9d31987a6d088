"""From elevations to accumulated flow, tile by tile: cells are shuffled to their tiles once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from thalweg.operators.accumulation import raster_accumulation
from thalweg.operators.flats import raster_drained, raster_flats
from thalweg.operators.flow_direction import raster_directions
from thalweg.operators.grid import shuffled
from thalweg.operators.least_cost import breached
from thalweg.operators.raster import KEY, Raster, to_cells, to_raster
from thalweg.operators.tiles import TILE
from thalweg.session import written_tiles


@dataclass
class Drainage:
    """elevations (z), flats (label, away, low, mask) and flow (fdr, fac) as tiles; there are the same in each."""

    elevations: Raster
    flats: Raster
    flow: Raster

    def cells(self) -> DataFrame:
        """row, col, z, fdr, label, flat_mask, fac."""
        table = self.elevations.table.select(*KEY, "z").join(shuffled(self.flats.table.select(*KEY, "label", "mask")), KEY).join(shuffled(self.flow.table), KEY)
        return to_cells(self.elevations.with_table(table), "z", "fdr", "label", "mask", "fac").withColumnRenamed("mask", "flat_mask")

    @property
    def dem(self) -> DataFrame:
        return to_cells(self.elevations, "z")

    @property
    def fdr(self) -> DataFrame:
        return to_cells(self.flow, "fdr")

    @property
    def mask(self) -> DataFrame:
        return to_cells(self.flats, "label", "away", "low", "mask").withColumnRenamed("mask", "flat_mask")

    @property
    def fac(self) -> DataFrame:
        return to_cells(self.flow, "fac")


def drainage(cells: DataFrame, nodata: float = -9999.0, radius: int | None = None, chunk_size: int | None = None, tile: int = TILE) -> Drainage:
    """Elevations (breached within radius, if given), directions (flats resolved), masks, accumulation."""
    kept = lambda raster, name: raster.with_table(written_tiles(raster.table, name))
    elevations = kept(breached(cells, nodata, radius, chunk_size, tile) if radius else to_raster(cells.select("row", "col", "z"), tile), "elevations")
    first = kept(raster_directions(elevations), "directions")
    flats = kept(raster_flats(first), "flats")
    drained = kept(raster_drained(flats), "drained")
    return Drainage(elevations, drained, kept(raster_accumulation(drained), "flow"))
