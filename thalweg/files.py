"""Operators from file to file: read a raster, apply an operator, write the result.

A path ending in .asc is an ASCII grid, one in .tif or .tiff a GeoTIFF (or a folder of
them, when it is read); any other path is a folder of Parquet cells with metadata.
Results are the same by their paths, and replace what is there.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from thalweg.functions.d8 import DEFAULT_CHUNK_SIZE, DEFAULT_MAX_PITS, DEFAULT_SEARCH_RADIUS, NODATA
from thalweg.operators import flow_direction as directions
from thalweg.operators import least_cost, pits
from thalweg.session import session
from thalweg.sources import geotiff, rasters


def read(spark: SparkSession, path: str) -> tuple[DataFrame, rasters.RasterMeta]:
    """(cells (row, col, z), null for nodata; metadata)"""
    if path.endswith(".asc"):
        return rasters.read_ascii(spark, path)
    if geotiff.is_tiff(path):
        return geotiff.read_tiff(spark, path)
    return rasters.read_cells(spark, path)


def write(cells: DataFrame, meta: rasters.RasterMeta, path: str, value: str = "z") -> None:
    if path.endswith(".asc"):
        rasters.write_ascii(cells, meta, path, value)
    elif geotiff.is_tiff(path):
        geotiff.write_tiff(cells, meta, path, value)
    else:
        rasters.write_cells(cells, meta, path)


def breach_single_cell_pits(input_path: str, output_path: str, chunk_size: int = DEFAULT_CHUNK_SIZE, spark: SparkSession | None = None) -> None:
    cells, meta = read(spark or session(), input_path)
    found = pits.breach_single_cell_pits(cells, meta.nodata, chunk_size)
    write(found.select("row", "col", "z"), replace(meta, dtype="Float32"), output_path)


def flow_direction(input_path: str, output_path: str, chunk_size: int = DEFAULT_CHUNK_SIZE, spark: SparkSession | None = None) -> None:
    """chunk_size changes nothing here: directions don't depend on tiles."""
    cells, meta = read(spark or session(), input_path)
    write(directions.flow_direction(cells), replace(meta, dtype="Byte", nodata=float(NODATA)), output_path, "fdr")


def breach_paths_least_cost(input_path: str, output_path: str, chunk_size: int = DEFAULT_CHUNK_SIZE, search_radius: int = DEFAULT_SEARCH_RADIUS, max_pits: int = DEFAULT_MAX_PITS, spark: SparkSession | None = None) -> None:
    cells, meta = read(spark or session(), input_path)
    found = least_cost.breach_paths_least_cost(cells, meta.nodata, search_radius, chunk_size, max_pits)
    write(found, replace(meta, dtype="Float32"), output_path)
