"""GeoTIFF as a data source: windows by blocks, files of any size, one file written by tasks."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg import files
from thalweg.operators import grid
from thalweg.sources import geotiff, rasters
from thalweg.sources.geotiff import FAR, big_head, heads_of, runs


def values(height, width, seed=1, kind="f4"):
    return np.random.default_rng(seed).integers(0, 200, (height, width)).astype(kind)


def cells_of(spark, z):
    rows, cols = np.divmod(np.arange(z.size), z.shape[1])
    return spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(rows, cols, z.ravel(), strict=True)], "row long, col long, z double")


def array_of(cells, height, width, r0=0, c0=0):
    out = np.full((height, width), np.nan)
    for r, c, z in cells.select("row", "col", "z").collect():
        out[r - r0, c - c0] = np.nan if z is None else z
    return out


@pytest.mark.parametrize("dtype", [k for k in rasters.PIXEL_TYPES if not k.startswith("C")])
def test_one_file_of_many_blocks(spark, tmp_path, dtype):
    z, path = values(50, 70), str(tmp_path / "a.tif")
    meta = rasters.RasterMeta(70, 50, dtype, 7.0, "EPSG:32633", [100.0, 2.0, 0.0, 900.0, 0.0, -2.0])
    geotiff.write_tiff(cells_of(spark, z), meta, path, block=16)
    found, read = geotiff.read_tiff(spark, path)
    assert read == meta and found.schema["z"].dataType.simpleString() == rasters.value_type(meta)
    assert np.array_equal(array_of(found, 50, 70), np.where(z == 7, np.nan, z), equal_nan=True)
    # a reader of whole files sees the same
    whole, same = rasters.decode_tiff((tmp_path / "a.tif").read_bytes())
    assert same == meta and np.array_equal(whole, z)
    assert os.listdir(tmp_path) == ["a.tif"]


def test_one_block_and_no_cells(spark, tmp_path):
    meta = rasters.RasterMeta(5, 3)
    z = values(3, 5)
    for name, cells in (("a.tif", cells_of(spark, z)), ("b.tif", cells_of(spark, z).limit(0))):
        geotiff.write_tiff(cells, meta, str(tmp_path / name), block=16)
    assert np.array_equal(array_of(geotiff.read_tiff(spark, str(tmp_path / "a.tif"))[0], 3, 5), z)
    empty = geotiff.read_tiff(spark, str(tmp_path / "b.tif"))[0]
    assert empty.count() == 15 and empty.where("z is not null").count() == 0


def test_cells_out_of_bounds_and_missing_ones(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (40, 39, 2.0), (5, 5, None), (-1, 0, 9.0), (41, 0, 9.0), (0, 40, 9.0)], "row long, col long, z double")
    path = str(tmp_path / "a.tif")
    geotiff.write_tiff(cells, rasters.RasterMeta(40, 41), path, block=16)
    found = geotiff.read_tiff(spark, path)[0]
    assert found.count() == 40 * 41
    assert sorted(tuple(r) for r in found.where("z is not null").collect()) == [(0, 0, 1.0), (40, 39, 2.0)]
    # blocks without cells take no room
    assert (np.array(rasters._tags((tmp_path / "a.tif").read_bytes())[1][rasters.TILE_COUNTS]) > 0).sum() == 2


def test_a_window_reads_only_its_blocks(spark, tmp_path):
    z, path = values(80, 96), tmp_path / "a.tif"
    geotiff.write_tiff(cells_of(spark, z), rasters.RasterMeta(96, 80), str(path), block=16)
    data = bytearray(path.read_bytes())
    _, tags = rasters._tags(bytes(data))
    for k, (at, n) in enumerate(zip(tags[rasters.TILE_OFFSETS], tags[rasters.TILE_COUNTS], strict=True)):
        if k // 6 not in (1, 2) or k % 6 not in (2, 3):
            data[at : at + n] = b"\xff" * n  # can't be read
    path.write_bytes(data)
    cells, _ = geotiff.read_tiff(spark, str(path))
    window = grid.window(cells, 20, 33, 25, 30)
    assert np.array_equal(array_of(window, 25, 30, 20, 33), z[20:45, 33:63])
    assert cells.where("row = 47 and col > 31 and col <= 40 and z >= 0 and row is not null").count() == 9
    with pytest.raises(Exception, match="Error"):
        cells.where("row < 20").count()
    head = heads_of(str(path))[1][0]
    count = lambda *w: sum((p.rows[1] - p.rows[0]) * (p.cols[1] - p.cols[0]) for p in runs(head, list(w)))
    assert count(20, 45, 33, 63) == 4 and count(0, FAR, 0, FAR) == 30 and count(80, FAR, 0, FAR) == count(5, 5, 0, 1) == 0


def test_partitions_are_runs_of_blocks(spark, tmp_path):
    geotiff.write_tiff(cells_of(spark, values(3, 3)), rasters.RasterMeta(1000, 600), str(tmp_path / "a.tif"), block=16)
    head = heads_of(str(tmp_path / "a.tif"))[1][0]
    for part in (1, 16 * 16 * 5, 16 * 16 * 63 * 3, 1 << 40):
        found = runs(head, [0, FAR, 0, FAR], part)
        blocks = [(r, c) for p in found for r in range(*p.rows) for c in range(*p.cols)]
        assert sorted(blocks) == [(r, c) for r in range(38) for c in range(63)]
        assert all((p.rows[1] - p.rows[0]) * (p.cols[1] - p.cols[0]) <= max(1, part // 256) for p in found)


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A file whose last block lies at 5 GB (with a hole before it)."""
    meta, z = rasters.RasterMeta(32, 64), values(32, 32)
    head, offsets, counts, data = big_head(meta, 32)
    with open(tmp_path / "a.tif", "wb") as out:
        out.write(head)
        for k, (at, rows) in enumerate(((data, z), (5 << 30, z + 1))):
            packed = zlib.compress(rows.tobytes())
            for place, part in ((at, packed), (offsets + 8 * k, struct.pack("<Q", at)), (counts + 8 * k, struct.pack("<Q", len(packed)))):
                os.pwrite(out.fileno(), part, place) if out.flush() is None else None
    assert os.path.getsize(tmp_path / "a.tif") > 5 << 30
    found, _ = geotiff.read_tiff(spark, str(tmp_path / "a.tif"))
    assert np.array_equal(array_of(found, 64, 32), np.concatenate([z, z + 1]))


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "a.tif"
    path.write_bytes(b"as it was")
    bad = cells_of(spark, values(20, 20)).withColumn("z", F.when(F.col("row") == 19, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("z")))
    with pytest.raises(Exception, match="broken"):
        geotiff.write_tiff(bad, rasters.RasterMeta(20, 20), str(path), block=16)
    assert os.listdir(tmp_path) == ["a.tif"] and path.read_bytes() == b"as it was"
    # blocks that fail as they are put in place
    aside = tmp_path / "aside"
    aside.write_bytes(b"")
    blocks = spark.range(8).select(F.col("id").alias("block"), F.col("id").alias("at"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        geotiff.registered(spark)
        blocks.write.format("geotiff").mode("append").options(aside=str(aside), path=str(path), offsets="100", counts="200", head="00").save()
    assert os.listdir(tmp_path) == ["a.tif"] and path.read_bytes() == b"as it was"


def test_other_compressions():
    z = np.repeat(values(4, 8, kind="u1"), 3, axis=1)
    packed = b"".join(bytes([257 - len(run), run[0]]) if len(set(run)) == 1 else bytes([len(run) - 1]) + run for run in (z.tobytes()[k : k + 3] for k in range(0, z.size, 3))) + b"\x80"
    zstandard = pytest.importorskip("zstandard")
    assert rasters.unpacked(packed, 32773) == z.tobytes()
    assert rasters.unpacked(b"\x02abc\xfez", 32773) == b"abczzz"
    assert rasters.unpacked(zstandard.ZstdCompressor().compress(z.tobytes()), 50000) == z.tobytes()
    with pytest.raises(ValueError, match="compression 7"):
        rasters.unpacked(b"", 7)


def test_folders_are_read_by_windows(spark, tmp_path):
    z = values(60, 50)
    meta = rasters.RasterMeta(50, 60, "Float32", -9999.0, "EPSG:4326", [10.0, 0.5, 0.0, 50.0, 0.0, -0.25])
    rasters.write_tiff_folder(cells_of(spark, z), meta, str(tmp_path / "tiles"), tile=20)
    (tmp_path / "tiles" / "2_2.tif").write_bytes(rasters.encode_tiff(np.zeros((20, 10)), rasters.RasterMeta(10, 20, "Float32", -9999.0, "EPSG:4326", [30.0, 0.5, 0.0, 40.0, 0.0, -0.25]))[:-60])
    (tmp_path / "tiles" / "notes.txt").write_text("no raster")
    with pytest.raises(struct.error):
        geotiff.read_tiff(spark, str(tmp_path / "tiles"))
    os.remove(tmp_path / "tiles" / "2_2.tif")
    found, read = geotiff.read_tiff(spark, str(tmp_path / "tiles"))
    assert read == meta
    assert np.array_equal(array_of(found.where("row >= 15 and row < 45 and col >= 10 and col < 40"), 30, 30, 15, 10), z[15:45, 10:40])
    with pytest.raises(FileNotFoundError):
        geotiff.read_tiff(spark, str(tmp_path / "none.tif"))
    os.mkdir(tmp_path / "empty")
    with pytest.raises(ValueError, match="no files"):
        geotiff.read_tiff(spark, str(tmp_path / "empty"))


def test_functions_by_paths(spark, tmp_path):
    z = values(30, 30)
    z[9, 9] = -5
    source = str(tmp_path / "in.tif")
    geotiff.write_tiff(cells_of(spark, z), rasters.RasterMeta(30, 30), source, block=16)
    for function, more in ((files.breach_single_cell_pits, {}), (files.flow_direction, {}), (files.breach_paths_least_cost, {"search_radius": 5, "max_pits": 2})):
        target = str(tmp_path / f"{function.__name__}.tif")
        function(source, target, 2000, spark=spark, **more)
        found, meta = geotiff.read_tiff(spark, target)
        assert found.count() == 900 and meta.dtype == ("Byte" if function is files.flow_direction else "Float32")
    with pytest.raises(ValueError, match="multiple of 16"):
        geotiff.write_tiff(cells_of(spark, z), rasters.RasterMeta(30, 30), source, block=20)
