"""Rasters in files, and the commands."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from test_goldens import cells, matrix
from thalweg import cli
from thalweg.sources import geotiff, rasters

DEM = [[2.0, 2.0, 2.0, 2.0, 2.0], [-1.0, 2.0, 2.0, 2.0, 2.0], [2.0, 2.0, 0.0, 2.0, 2.0], [2.0] * 5, [2.0, 2.0, 2.0, 2.0, None]]


@pytest.mark.parametrize("dtype", [k for k in rasters.PIXEL_TYPES if not k.startswith("C")])
def test_tiff_round_trip(dtype):
    z = np.arange(12 * 7).reshape(12, 7).astype(rasters.PIXEL_TYPES[dtype][0])
    meta = rasters.RasterMeta(7, 12, dtype, 3.0, "EPSG:4326", [10.0, 0.5, 0.0, 50.0, 0.0, -0.25])
    back, read = rasters.decode_tiff(rasters.encode_tiff(z, meta, rows_per_strip=5))
    assert np.array_equal(back, z) and read == meta


def test_read_tiff(spark, tmp_path):
    z = np.array([[1, 2], [-9999, 4]], "f4")
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(z, rasters.RasterMeta(2, 2)))
    found, meta = geotiff.read_tiff(spark, str(tmp_path / "a.tif"))
    assert matrix(found, "z") == [[1.0, 2.0], [None, 4.0]] and meta.nodata == -9999.0
    (tmp_path / "b.tif").write_bytes(rasters.encode_tiff(z, rasters.RasterMeta(2, 2, nodata=None)))
    with pytest.raises(ValueError, match="nodata"):
        geotiff.read_tiff(spark, str(tmp_path / "b.tif"))


@pytest.mark.parametrize("predictor", [2, 3])
@pytest.mark.parametrize(("order", "big", "tiled", "bands"), [("<", False, False, 1), (">", True, True, 1), ("<", True, False, 3), ("<", False, True, 2)])
def test_tiffs_of_others(order, big, tiled, bands, predictor):
    """Predictors, LZW, big files, tiles and several bands, packed here by plain rules."""
    kind = "f4" if predictor == 3 else "i2"
    z = (np.arange(70 * 50).reshape(70, 50) % 97 * 3 - 40).astype(kind)
    data = plain_tiff(z, order, big, tiled, bands, predictor)
    back, meta = rasters.decode_tiff(data)
    assert np.array_equal(back, z) and (meta.width, meta.height, meta.nodata, meta.projection) == (50, 70, -9.0, "EPSG:32633")
    assert meta.geotransform == [100.0, 2.0, 0.0, 900.0, 0.0, -3.0]


def lzw(data: bytes) -> bytes:
    """Packs as the format wants: the code widens one entry early, the table is cleared before it is full."""
    bits, width, table, now = [], 9, {bytes([k]): k for k in range(256)}, b""
    next_code = 258
    put = lambda code: bits.append(format(code, f"0{width}b"))
    put(256)
    for byte in data:
        if now + bytes([byte]) in table:
            now += bytes([byte])
            continue
        put(table[now])
        table[now + bytes([byte])] = next_code
        next_code += 1
        if next_code == 4095:
            put(256)
            table, next_code = {bytes([k]): k for k in range(256)}, 258
        width = min(12, max(9, next_code.bit_length()))
        now = bytes([byte])
    if now:
        put(table[now])
        width = min(12, max(9, (next_code + 1).bit_length()))
    put(257)
    flat = "".join(bits)
    flat += "0" * (-len(flat) % 8)
    return int(flat, 2).to_bytes(len(flat) // 8, "big")


def plain_tiff(z, order: str, big: bool, tiled: bool, bands: int, predictor: int) -> bytes:
    h, w = z.shape
    th, tw = (32, 32) if tiled else (16, w)
    blocks = []
    for r in range(0, h, th):
        for c in range(0, w, tw):
            block = np.zeros((th, tw, bands), z.dtype)
            part = z[r : r + th, c : c + tw]
            block[: part.shape[0], : part.shape[1], 0] = part
            block[:, :, 1:] = 7
            block = block if tiled else block[: part.shape[0]]
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = block.astype(order + z.dtype.str[1:]).tobytes()
            else:
                size = z.dtype.itemsize
                planes = block.astype(">" + z.dtype.str[1:]).reshape(len(block), tw * bands, 1).view("u1").reshape(len(block), tw * bands, size)
                flat = planes.transpose(0, 2, 1).reshape(len(block), size * tw, bands)
                raw = np.diff(flat, axis=1, prepend=np.zeros_like(flat[:, :1])).astype("u1").tobytes()
            blocks.append(lzw(raw))
    keys = (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32633)
    matrix = (2.0, 0.0, 0.0, 100.0, 0.0, -3.0, 0.0, 900.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    kinds = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
    start, at, offsets = (16 if big else 8), (16 if big else 8), []
    for x in blocks:
        offsets.append(at)
        at += len(x)
    tags = [(256, "I", (w,)), (257, "I", (h,)), (258, "H", (8 * z.dtype.itemsize,) * bands), (259, "H", (5,)), (277, "H", (bands,)), (284, "H", (1,)), (317, "H", (predictor,)), (339, "H", (3 if predictor == 3 else 2,) * bands), (34264, "d", matrix), (34735, "H", keys), (42113, "s", b"-9\0")]
    where = "Q" if big else "I"
    tags += [(322, "I", (tw,)), (323, "I", (th,)), (324, where, tuple(offsets)), (325, where, tuple(map(len, blocks)))] if tiled else [(278, "I", (th,)), (273, where, tuple(offsets)), (279, where, tuple(map(len, blocks)))]
    word, inline, entry, count = ("Q", 8, 20, "Q") if big else ("I", 4, 12, "H")
    more = at + struct.calcsize(order + count) + entry * len(tags) + inline
    entries, body = b"", b""
    for tag, form, values in sorted(tags):
        packed = bytes(values) if form == "s" else struct.pack(order + form * len(values), *values)
        entries += struct.pack(order + "HH" + word, tag, kinds[form], len(values))
        if len(packed) <= inline:
            entries += packed.ljust(inline, b"\0")
        else:
            entries += struct.pack(order + word, more + len(body))
            body += packed
    mark = b"II" if order == "<" else b"MM"
    head = mark + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, at) if big else struct.pack(order + "I", at))
    assert len(head) == start
    return head + b"".join(blocks) + struct.pack(order + count, len(tags)) + entries + b"\0" * inline + body


def test_folders_of_tiffs_are_placed_by_georeference(spark, tmp_path):
    meta = rasters.RasterMeta(5, 5, "Float32", -9999.0, "EPSG:4326", [10.0, 0.5, 0.0, 50.0, 0.0, -0.25])
    rasters.write_tiff_folder(cells(spark, DEM), meta, str(tmp_path / "tiles.tif"), tile=3)
    assert len(list((tmp_path / "tiles.tif").glob("*.tif"))) == 4
    found, read = geotiff.read_tiff(spark, str(tmp_path / "tiles.tif"))
    assert matrix(found, "z") == DEM and read == meta
    (tmp_path / "tiles.tif" / "z.tif").write_bytes(rasters.encode_tiff(np.zeros((1, 1)), rasters.RasterMeta(1, 1, "Float32", -9999.0, "EPSG:4326", [10.0, 0.7, 0.0, 50.0, 0.0, -0.25])))
    with pytest.raises(ValueError, match="differ"):
        geotiff.read_tiff(spark, str(tmp_path / "tiles.tif"))


def test_commands_write_tiffs(spark, tmp_path):
    source, target = tmp_path / "in.tif", tmp_path / "out.tif"
    z = np.array([[v if v is not None else -9999.0 for v in row] for row in DEM], "f4")
    source.write_bytes(rasters.encode_tiff(z, rasters.RasterMeta(5, 5)))
    assert cli.main(["flow-direction", "--input_file", str(source), "--output_file", str(target)], spark) == 0
    codes, meta = rasters.decode_tiff(target.read_bytes())
    assert meta.dtype == "Byte" and meta.nodata == 9.0 and codes[4, 4] == 9 and codes.shape == (5, 5)
    found, _ = geotiff.read_tiff(spark, str(target))
    assert found.where("z is null").count() == 1


def test_sparse_cells_count_as_nodata(spark):
    """A table that lacks the rows of nodata cells has the same directions as one that has them."""
    from thalweg.operators.flow_direction import flow_direction

    full = cells(spark, DEM)
    wanted = {(r["row"], r["col"]): r["fdr"] for r in flow_direction(full).collect()}
    found = {(r["row"], r["col"]): r["fdr"] for r in flow_direction(full.where("z is not null and not (row = 2 and col = 3)")).collect()}
    hidden = {(r["row"], r["col"]): r["fdr"] for r in flow_direction(full.selectExpr("row", "col", "case when row = 2 and col = 3 then null else z end as z")).collect()}
    assert found == {k: v for k, v in hidden.items() if k not in ((4, 4), (2, 3))} and wanted.keys() == hidden.keys()


def test_tiles_as_tiff(spark):
    meta = rasters.RasterMeta(5, 5)
    tiles = {r["name"]: bytes(r["content"]) for r in rasters.tiff_tiles(cells(spark, DEM), meta, tile=4).collect()}
    assert sorted(tiles) == ["0_0.tif", "0_1.tif", "1_0.tif", "1_1.tif"]
    z, own = rasters.decode_tiff(tiles["1_1.tif"])
    assert z.tolist() == [[-9999.0]] and own.geotransform[0] == 4.0


def test_ascii_round_trip(spark, tmp_path):
    path = str(tmp_path / "dem.asc")
    rasters.write_ascii(cells(spark, DEM), rasters.RasterMeta(5, 5), path)
    found, meta = rasters.read_ascii(spark, path)
    assert matrix(found, "z") == DEM and (meta.width, meta.height) == (5, 5)


@pytest.mark.parametrize("splits", ["128m", "64b"])
def test_ascii_grid_of_several_files(spark, tmp_path, splits):
    """Later parts are larger than the head's, so that Spark's order of files and splits is not that of their names."""
    rows = [[float(r * 10 + c) for c in range(3 + r // 20)] + [0.0] * (4 - r // 20) for r in range(60)]
    cuts = (0, 1, 3, 12, 60)
    lines = [" ".join(f"{x:.{1 + r // 10}f}" for x in row) for r, row in enumerate(rows)]
    (tmp_path / "grid.asc").mkdir()
    head = "ncols 7\nnrows 60\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n"
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / "grid.asc" / f"part-0000{k}.txt").write_text((head if not k else "") + "\n".join(lines[a:b]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    try:
        found, meta = rasters.read_ascii(spark, str(tmp_path / "grid.asc"))
        assert matrix(found, "z") == rows and (meta.width, meta.height) == (7, 60)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pixel_types():
    assert rasters.spark_type("UInt32") == "long"
    with pytest.raises(KeyError):
        rasters.spark_type("Int64")


@pytest.mark.parametrize(("command", "value"), [("breach-single-cell-pits", "z"), ("breach-paths-least-cost", "z"), ("flow-direction", "fdr")])
def test_commands(spark, tmp_path, command, value):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rasters.write_cells(cells(spark, DEM).fillna(-9999.0), rasters.RasterMeta(5, 5), source)
    assert cli.main([command, "--input_file", source, "--output_file", target], spark) == 0
    found, meta = rasters.read_cells(spark, target, value)
    assert found.count() == 25 and (meta.width, meta.height) == (5, 5)


def test_commands_report_failures(spark, tmp_path, capsys):
    assert cli.main(["flow-direction", "--input_file", str(tmp_path / "none"), "--output_file", "x"], spark) == 1
    assert "flow-direction failed with the following exception" in capsys.readouterr().err
