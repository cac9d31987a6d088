"""Rasters in files: Parquet cells with metadata, ASCII grids, and what GeoTIFF files are made of.

Cells are Parquet sorted by tile, so that windows skip row groups. The lines of an ASCII
grid are dealt to tasks. Of a GeoTIFF (see geotiff.py), classic or big, band 1 is read,
in strips or tiles, plain, PackBits, LZW, deflated or Zstandard, with or without a
predictor; anything else raises. A raster may be written as a folder of small GeoTIFFs.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators.grid import normalise

# Pixel types by name, with numpy's and Spark's type.
PIXEL_TYPES = {
    "Byte": ("u1", "short"),
    "UInt16": ("u2", "int"),
    "Int16": ("i2", "short"),
    "UInt32": ("u4", "long"),
    "Int32": ("i4", "int"),
    "Float32": ("f4", "float"),
    "Float64": ("f8", "double"),
    "CInt16": ("c8", "struct<re:float,im:float>"),
    "CFloat32": ("c8", "struct<re:float,im:float>"),
    "CInt32": ("c16", "struct<re:double,im:double>"),
    "CFloat64": ("c16", "struct<re:double,im:double>"),
}
META = "width long, height long, dtype string, nodata double, projection string, geotransform array<double>"
TILE = 512


@dataclass
class RasterMeta:
    width: int
    height: int
    dtype: str = "Float32"
    nodata: float | None = -9999.0
    projection: str = ""
    geotransform: list[float] = field(default_factory=lambda: [0.0, 1.0, 0.0, 0.0, 0.0, -1.0])


def spark_type(pixel_type: str) -> str:
    return PIXEL_TYPES[pixel_type][1]


def needs_nodata(meta: RasterMeta) -> RasterMeta:
    if meta.nodata is None:
        raise ValueError("the raster has no nodata value")
    return meta


def write_cells(cells: DataFrame, meta: RasterMeta, path: str, tile: int = TILE) -> None:
    """Write cells and metadata; replaces what is there."""
    placed = cells.withColumns({"tile_row": F.floor(F.col("row") / tile).cast("int"), "tile_col": F.floor(F.col("col") / tile).cast("int")})
    placed.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").drop("tile_row", "tile_col").write.mode("overwrite").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([asdict(meta)], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> RasterMeta:
    return RasterMeta(**spark.read.schema(META).parquet(f"{path}/meta").first().asDict())


def read_cells(spark: SparkSession, path: str, value: str = "z") -> tuple[DataFrame, RasterMeta]:
    """(cells with null for nodata, metadata)."""
    meta = needs_nodata(read_meta(spark, path))
    cells = spark.read.parquet(f"{path}/cells")
    return normalise(cells, meta.nodata, value, cells.schema[value].dataType.simpleString()), meta


def ascii_header(lines: list[str]) -> tuple[dict[str, float], int]:
    """The header of an ASCII grid and how many lines it has."""
    found = {}
    for n, line in enumerate(lines):
        words = line.split()
        if len(words) != 2 or not words[0][0].isalpha():
            return found, n
        found[words[0].lower()] = float(words[1])
    return found, len(lines)


def read_ascii(spark: SparkSession, path: str) -> tuple[DataFrame, RasterMeta]:
    """One ASCII grid, a file or the parts of one in order of their names; its rows are dealt to tasks by line."""
    # Spark deals out files and their splits by size, so lines are ordered by the split that they come from
    text = spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("at"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("part"))
    head, n = ascii_header([r["value"] for r in text.orderBy("part", "at").limit(8).collect()])
    width, height, size = int(head["ncols"]), int(head["nrows"]), head.get("cellsize", 1.0)
    half = size / 2 if "xllcenter" in head else 0.0
    left, bottom = head.get("xllcorner", head.get("xllcenter", 0.0)) - half, head.get("yllcorner", head.get("yllcenter", 0.0)) - half
    meta = RasterMeta(width, height, "Float32", head.get("nodata_value", -9999.0), "", [left, size, 0.0, bottom + height * size, 0.0, -size])
    # lines are numbered by splits: counts of the splits before, and the first line's id, for each split
    before, start = [], 0
    for part, rows, first in sorted(text.groupBy("part").agg(F.count("*"), F.min("at")).collect()):
        before.append((part, start - first))
        start += rows
    starts = spark.createDataFrame(before, "part struct<file_path: string, file_block_start: long>, before long")
    lines = text.join(F.broadcast(starts), "part").select((F.col("at") + F.col("before") - n).alias("row"), F.trim("value").alias("value"))
    cells = lines.where((F.col("row") >= 0) & (F.col("value") != "")).select("row", F.posexplode(F.split("value", r"\s+")).alias("col", "z")).select("row", F.col("col").cast("long").alias("col"), F.col("z").cast("float").alias("z"))
    return normalise(cells, meta.nodata), meta


def write_ascii(cells: DataFrame, meta: RasterMeta, path: str, value: str = "z") -> None:
    """Text files whose parts, one after the other, are an ASCII grid; rows in order."""
    spark, t = cells.sparkSession, meta.geotransform
    head = "\n".join([f"ncols {meta.width}", f"nrows {meta.height}", f"xllcorner {t[0]}", f"yllcorner {t[3] + meta.height * t[5]}", f"cellsize {t[1]}", f"NODATA_value {meta.nodata}"])
    each = F.struct("col", F.coalesce(F.col(value).cast("string"), F.lit(str(meta.nodata))).alias("v"))
    rows = cells.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["v"]), " ").alias("value"))
    rows.unionByName(spark.createDataFrame([(-1, head)], "row long, value string")).orderBy("row").select("value").write.mode("overwrite").text(path)


# TIFF tags and types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
_SCALE, _TIE, _MATRIX, _KEYS, _ASCII_PARAMS, _NODATA = 33550, 33922, 34264, 34735, 34737, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS, _ZSTANDARD = 1, 5, 8, 32946, 32773, 50000
# Keys of the georeference (model, raster, geographic and projected system), and codes of models.
_MODEL_KEY, _RASTER_KEY, _GEOGRAPHIC_KEY, _PROJECTED_KEY, _PROJECTED, _GEOGRAPHIC, _USER_DEFINED = 1024, 1025, 2048, 3072, 1, 2, 32767


def _unlzw(data: bytes) -> bytes:
    """What the format's LZW has packed: codes of 9 to 12 bits, the highest bit first."""
    clear, end = 256, 257
    table: list[bytes] = []
    out, width, held, bits, before = [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == end:
            break
        if code == clear:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table):
            raise ValueError("damaged LZW data")
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        # the code widens one entry before it must
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _unpackbits(data: bytes) -> bytes:
    """What runs of equal bytes and stretches of different ones stand for."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n if n > 128 else 0))
            at += 2 if n > 128 else 1
    return b"".join(out)


def _unzstandard(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def unpacked(data: bytes, compression: int) -> bytes:
    unpack = {_NONE: bytes, _LZW: _unlzw, _DEFLATE: zlib.decompress, _OLD_DEFLATE: zlib.decompress, _PACKBITS: _unpackbits, _ZSTANDARD: _unzstandard}.get(compression)
    if unpack is None:
        raise ValueError(f"compression {compression} is not supported")
    return unpack(data)


def unpredicted(block, predictor: int, order: str, kind: str):
    """Rows (rows, columns, samples) with the differences between columns summed up again."""
    import numpy as np

    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:  # bytes of a row, the highest ones first, as differences
        rows, columns, samples = block.shape
        size = int(kind[1:])
        flat = np.cumsum(block.view("u1").reshape(rows, columns * size, samples), axis=1, dtype="u1")
        planes = flat.reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">" + kind).reshape(rows, columns, samples)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return block


def directory(read) -> tuple[str, dict[int, tuple[str, int, int]]]:
    """(byte order, tag -> (form, number of values, their place)) of the first image of a classic or a big TIFF; read(at, n) gives bytes."""
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    version = order and struct.unpack(order + "H", read(2, 2))[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), read(8 if big else 4, 8 if big else 4))[0]
    count, word, size, inline = ("Q", "Q", 20, 8) if big else ("H", "I", 12, 4)
    begin = at + struct.calcsize(order + count)
    n = struct.unpack(order + count, read(at, struct.calcsize(order + count)))[0]
    entries, found = read(begin, size * n), {}
    for k in range(n):
        tag, kind, number = struct.unpack_from(order + "HH" + word, entries, size * k)
        form = _TYPES.get(kind)
        if form:
            value = size * (k + 1) - inline
            place = begin + value if struct.calcsize(order + form) * number <= inline else struct.unpack_from(order + word, entries, value)[0]
            found[tag] = (form, number, place)
    return order, found


def tag_values(read, order: str, entry: tuple[str, int, int]) -> tuple:
    form, n, place = entry
    packed = f"{order}{n}s" if form == "s" else f"{order}{n * len(form)}{form[0]}"
    return struct.unpack(packed, read(place, struct.calcsize(packed)))


def table_part(read, order: str, entry: tuple[str, int, int], first: int, last: int) -> tuple[int, ...]:
    """Values first to last (excluded) of a tag, and no others."""
    form, n, place = entry
    size = struct.calcsize(order + form)
    last = min(last, n)
    return struct.unpack(f"{order}{last - first}{form}", read(place + size * first, size * (last - first)))


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    read = lambda at, n: data[at : at + n]
    order, entries = directory(read)
    return order, {tag: tag_values(read, order, e) for tag, e in entries.items()}


def _projection(tags: dict[int, tuple]) -> str:
    """EPSG:n by the georeference's keys, else its text."""
    keys = tags.get(_KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = found.get(_PROJECTED_KEY) or found.get(_GEOGRAPHIC_KEY)
    if code and code != _USER_DEFINED:
        return f"EPSG:{code}"
    return tags[_ASCII_PARAMS][0].split(b"\0")[0].decode() if _ASCII_PARAMS in tags else ""


def meta_of(tags: dict[int, tuple]) -> RasterMeta:
    one = lambda tag, default=0: tags.get(tag, (default,))[0]
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1), "?") + str(one(BITS, 8) // 8)
    names = {v[0]: k for k, v in PIXEL_TYPES.items() if not k.startswith("C")}
    if kind not in names or len(set(tags.get(BITS, (8,)))) > 1:
        raise ValueError(f"pixels of type {kind} are not supported")
    nodata = float(tags[_NODATA][0].split(b"\0")[0]) if _NODATA in tags else None
    if _MATRIX in tags:
        m = tags[_MATRIX]
        transform = [m[3], m[0], m[1], m[7], m[4], m[5]]
    else:
        scale, tie = tags.get(_SCALE, (1.0, 1.0, 0.0)), tags.get(_TIE, (0.0,) * 6)
        transform = [tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]]
    return RasterMeta(one(WIDTH), one(HEIGHT), names[kind], nodata, _projection(tags), transform)


def decode_tiff(data: bytes):
    """(array of band 1, RasterMeta) of a TIFF: strips or tiles, plain, LZW or deflated, with predictors."""
    import numpy as np

    order, tags = _tags(data)
    meta = meta_of(tags)
    one = lambda tag, default=0: tags.get(tag, (default,))[0]
    width, height, kind = meta.width, meta.height, PIXEL_TYPES[meta.dtype][0]
    compression, apart = one(COMPRESSION, _NONE), one(PLANAR, 1) == 2
    samples = 1 if apart else one(SAMPLES, 1)
    tiled = TILE_OFFSETS in tags
    th, tw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    down, across = -(-height // th), -(-width // tw)
    out = np.zeros((down * th, across * tw), kind)
    if meta.nodata is not None:
        out[:] = np.array(meta.nodata).astype(kind)
    for k, (o, n) in enumerate(zip(offsets[: down * across], counts[: down * across], strict=True)):
        if not n:
            continue  # a tile that the file leaves out
        block = np.frombuffer(unpacked(data[o : o + n], compression), order + kind)
        block = block[: len(block) // (tw * samples) * tw * samples].reshape(-1, tw, samples)[:th]
        block = unpredicted(block, one(PREDICTOR, 1), order, kind)[:, :, 0]
        r, c = divmod(k, across)
        out[r * th : r * th + len(block), c * tw : (c + 1) * tw] = block
    return out[:height, :width], meta


def image_tags(meta: RasterMeta) -> list[tuple[int, int, tuple]]:
    """(tag, type, values) of a deflated image of one band, but for where it lies in the file."""
    t, kind = meta.geotransform, PIXEL_TYPES[meta.dtype][0]
    tags: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (meta.width,)), (HEIGHT, 4, (meta.height,)), (BITS, 3, (8 * int(kind[1:]),)), (COMPRESSION, 3, (_DEFLATE,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind[0]],)),
    ]
    if t[2] or t[4]:
        tags.append((_MATRIX, 12, (t[1], t[2], 0.0, t[0], t[4], t[5], 0.0, t[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    else:
        tags += [(_SCALE, 12, (t[1], -t[5], 0.0)), (_TIE, 12, (0.0, 0.0, 0.0, t[0], t[3], 0.0))]
    code = meta.projection.removeprefix("EPSG:")
    if code != meta.projection and code.isdigit():
        geographic = 4000 <= int(code) < 5000
        keys = ((_MODEL_KEY, 0, 1, _GEOGRAPHIC if geographic else _PROJECTED), (_RASTER_KEY, 0, 1, 1), (_GEOGRAPHIC_KEY if geographic else _PROJECTED_KEY, 0, 1, int(code)))
        tags.append((_KEYS, 3, (1, 1, 0, len(keys), *(x for key in keys for x in key))))
    elif meta.projection:
        tags.append((_ASCII_PARAMS, 2, (meta.projection.encode() + b"\0",)))
    if meta.nodata is not None:
        tags.append((_NODATA, 2, (repr(meta.nodata).encode() + b"\0",)))
    return tags


def tag_bytes(form: int, values: tuple) -> bytes:
    return values[0] if form == 2 else struct.pack("<" + _TYPES[form] * len(values), *values)


def value_type(meta: RasterMeta) -> str:
    """Spark's type of elevations."""
    return "double" if meta.dtype == "Float64" else "float"


def encode_tiff(array, meta: RasterMeta, rows_per_strip: int = 64) -> bytes:
    """A classic little-endian TIFF of one band, in deflated strips."""
    import numpy as np

    kind = PIXEL_TYPES[meta.dtype][0]
    array = np.ascontiguousarray(array, "<" + kind)
    strips = [zlib.compress(array[r : r + rows_per_strip].tobytes()) for r in range(0, meta.height, rows_per_strip)]
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s)
    tags = image_tags(meta) + [(STRIP_OFFSETS, 4, tuple(offsets)), (STRIP_ROWS, 4, (rows_per_strip,)), (STRIP_COUNTS, 4, tuple(map(len, strips)))]
    tags.sort()
    at += at % 2
    more, body = at + 2 + 12 * len(tags) + 4, b""
    entries = []
    for tag, form, values in tags:
        packed = tag_bytes(form, values)
        n = len(packed) if form == 2 else len(values)
        if len(packed) <= 4:
            entries.append(struct.pack("<HHI", tag, form, n) + packed.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, form, n, more + len(body)))
            body += packed + b"\0" * (len(packed) % 2)
    head = b"II*\0" + struct.pack("<I", at) + b"".join(strips)
    return head.ljust(at, b"\0") + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4 + body


def write_tiff_folder(cells: DataFrame, meta: RasterMeta, path: str, value: str = "z", tile: int = 4096) -> None:
    """A folder at path with a GeoTIFF for each tile, placed by its georeference.

    Tasks encode their tiles and write them to the folder, each under another name first:
    a repeated task replaces its file.
    """

    def save(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _save(f"{path.rstrip('/')}/{name}", content.as_py())
            yield pa.RecordBatch.from_arrays([b.column(0)], ["name"])

    tiff_tiles(cells, meta, value, tile).mapInArrow(save, "name string").count()


def _save(path: str, content: bytes) -> None:
    import os
    import uuid

    from pyarrow import fs

    where = path if ":" in path.split("/")[0] else f"file://{os.path.abspath(path)}"
    system, place = fs.FileSystem.from_uri(where)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    aside = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(content)
    system.move(aside, place)


def tiff_tiles(cells: DataFrame, meta: RasterMeta, value: str = "z", tile: int = 4096) -> DataFrame:
    """name, content: an encoded GeoTIFF for each tile."""
    nodata = meta.nodata

    def run(key, rows):
        import numpy as np
        import pandas as pd

        y0, x0 = int(key[0]) * tile, int(key[1]) * tile
        own = RasterMeta(min(tile, meta.width - x0), min(tile, meta.height - y0), meta.dtype, nodata, meta.projection, list(meta.geotransform))
        own.geotransform[0] += x0 * meta.geotransform[1]
        own.geotransform[3] += y0 * meta.geotransform[5]
        z = np.full((own.height, own.width), nodata, PIXEL_TYPES[meta.dtype][0])
        known = rows[rows["v"].notna()]
        z[known["row"] - y0, known["col"] - x0] = known["v"]
        return pd.DataFrame({"name": [f"{key[0]}_{key[1]}.tif"], "content": [encode_tiff(z, own)]})

    at = cells.select("row", "col", F.col(value).cast("double").alias("v"), F.floor(F.col("row") / tile).alias("ty"), F.floor(F.col("col") / tile).alias("tx"))
    return at.groupBy("ty", "tx").applyInPandas(run, "name string, content binary")
