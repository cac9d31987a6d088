"""GeoTIFF as a data source of Spark: scans by blocks, and one file written by all tasks.

A scan's partitions are runs of blocks (strips or tiles), of PART_CELLS cells or one block
at least. Tasks read the byte ranges of their blocks and of those blocks' entries in the
file's tables, never a whole file, so a file may be of any size. Filters that bound row
and col choose the blocks. A raster may be a folder of files placed by their
georeference; their heads are read side by side on the driver, one small read each.

A raster is written as one tiled BigTIFF. Tasks encode blocks; the sums of the blocks'
sizes give each one's place, where tasks then put it, and its entries in the tables of
offsets, in a file beside the target. The commit writes the head and renames that file;
if a task fails, it is removed. A repeated task writes the same bytes to the same place.
Blocks that have no cell are left out. The path must be one that all machines see as
files; where there are object stores only, rasters.write_tiff_folder serves.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from thalweg.operators.tiles import each_tile, place
from thalweg.session import discard, written
from thalweg.sources import rasters
from thalweg.sources.rasters import PIXEL_TYPES, RasterMeta

FORMAT = "geotiff"
#: Cells that a partition of a scan holds, if blocks are smaller.
PART_CELLS = 1 << 22
BLOCK = 512
#: Bytes of a file that are read for its head at once.
HEAD_BYTES = 1 << 16
FAR = 1 << 62


@dataclass
class Head:
    """What a task must know of a file: its raster, its blocks, and where the tables of their places are."""

    path: str
    meta: RasterMeta
    order: str
    block: tuple[int, int]
    across: int
    compression: int
    predictor: int
    samples: int
    offsets: tuple[str, int, int]
    counts: tuple[str, int, int]
    #: Place in the whole raster.
    row: int = 0
    col: int = 0


def file_at(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{os.path.abspath(path)}")


def files_of(path: str) -> list[str]:
    """The TIFF files of a path: itself, or those of a folder."""
    from pyarrow import fs

    system, at = file_at(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name.endswith((".tif", ".tiff")))
    if not found:
        raise ValueError("there are no files")
    return [f"{path.rstrip('/')}/{name}" for name in found]


def ranged(file) -> Callable[[int, int], bytes]:
    """Reads n bytes at a place; the beginning of a file is read once."""
    begin = file.read_at(HEAD_BYTES, 0)

    def read(at: int, n: int) -> bytes:
        return begin[at : at + n] if at + n <= len(begin) else file.read_at(n, at)

    return read


def head_of(path: str) -> Head:
    system, at = file_at(path)
    with system.open_input_file(at) as file:
        read = ranged(file)
        order, entries = rasters.directory(read)
        tiled = rasters.TILE_OFFSETS in entries
        tables = (rasters.TILE_OFFSETS, rasters.TILE_COUNTS) if tiled else (rasters.STRIP_OFFSETS, rasters.STRIP_COUNTS)
        tags = {tag: rasters.tag_values(read, order, e) for tag, e in entries.items() if tag not in tables}
        meta = rasters.meta_of(tags)
        one = lambda tag, default: tags.get(tag, (default,))[0]
        height, width = (one(rasters.TILE_HEIGHT, 0), one(rasters.TILE_WIDTH, 0)) if tiled else (min(one(rasters.STRIP_ROWS, meta.height), meta.height), meta.width)
        samples = 1 if one(rasters.PLANAR, 1) == 2 else one(rasters.SAMPLES, 1)
        return Head(path, meta, order, (height, width), -(-meta.width // width), one(rasters.COMPRESSION, 1), one(rasters.PREDICTOR, 1), samples, *(entries[t] for t in tables))


def heads_of(path: str) -> tuple[RasterMeta, list[Head]]:
    """The whole raster, and its files placed in it; raises ValueError if they don't fit together."""
    paths = files_of(path)
    if len(paths) == 1:
        heads = [head_of(paths[0])]
    else:
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(head_of, paths))
    metas = [h.meta for h in heads]
    first, t = metas[0], metas[0].geotransform
    if len(heads) == 1:
        return first, heads
    same = lambda m: (m.dtype, m.projection, m.nodata, *(m.geotransform[k] for k in (1, 2, 4, 5)))
    if t[2] or t[4] or any(same(m) != same(first) for m in metas):
        raise ValueError("the files differ in type, nodata, projection or pixel size, or are turned")
    left, top = min(m.geotransform[0] for m in metas), max(m.geotransform[3] for m in metas) if t[5] < 0 else min(m.geotransform[3] for m in metas)
    for h in heads:
        h.row, h.col = round((h.meta.geotransform[3] - top) / t[5]), round((h.meta.geotransform[0] - left) / t[1])
    width, height = max(h.col + h.meta.width for h in heads), max(h.row + h.meta.height for h in heads)
    return RasterMeta(width, height, first.dtype, first.nodata, first.projection, [left, t[1], 0.0, top, 0.0, t[5]]), heads


@dataclass
class Blocks(InputPartition):
    """A rectangle of a file's blocks: rows first to last, columns first to last (after the last)."""

    head: Head
    rows: tuple[int, int]
    cols: tuple[int, int]


def runs(head: Head, window: list[int], part: int = PART_CELLS) -> list[Blocks]:
    """The partitions of a file's blocks that a window (first row, row after the last, likewise columns) of the whole raster meets."""
    height, width = head.block
    r0, r1 = max(0, window[0] - head.row), min(head.meta.height, window[1] - head.row)
    c0, c1 = max(0, window[2] - head.col), min(head.meta.width, window[3] - head.col)
    if r0 >= r1 or c0 >= c1:
        return []
    down, across = (r0 // height, -(-r1 // height)), (c0 // width, -(-c1 // width))
    wide = min(across[1] - across[0], max(1, part // (height * width)))
    tall = max(1, part // (height * width * wide))
    return [Blocks(head, (a, min(a + tall, down[1])), (b, min(b + wide, across[1]))) for a in range(down[0], down[1], tall) for b in range(across[0], across[1], wide)]


def decoded(content: bytes, head: Head):
    """The rows of a block's first band, fewer than a block's at the end of a strip."""
    import numpy as np

    kind, (height, width) = PIXEL_TYPES[head.meta.dtype][0], head.block
    block = np.frombuffer(rasters.unpacked(content, head.compression), head.order + kind)
    block = block[: len(block) // (width * head.samples) * width * head.samples].reshape(-1, width, head.samples)[:height]
    return rasters.unpredicted(block, head.predictor, head.order, kind)[:, :, 0]


class TiffReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.window = path, kind, [0, FAR, 0, FAR]

    def pushFilters(self, filters):
        for f in filters:
            at = {("row",): 0, ("col",): 2}.get(getattr(f, "attribute", None))
            value = getattr(f, "value", None)
            if at is None or isinstance(f, IsNotNull):
                if at is None:
                    yield f
                continue
            if not isinstance(value, int) or type(f) not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                yield f
                continue
            low = value + isinstance(f, GreaterThan) if not isinstance(f, LessThan | LessThanOrEqual) else 0
            high = value + (not isinstance(f, LessThan)) if not isinstance(f, GreaterThan | GreaterThanOrEqual) else FAR
            self.window[at], self.window[at + 1] = max(self.window[at], low), min(self.window[at + 1], high)

    def partitions(self):
        return [p for head in heads_of(self.path)[1] for p in runs(head, self.window)]

    def read(self, partition: Blocks) -> Iterator:
        import numpy as np
        import pyarrow as pa

        head, (height, width) = partition.head, partition.head.block
        kind = pa.float64() if self.kind == "double" else pa.float32()
        nodata = np.array(head.meta.nodata).astype(PIXEL_TYPES[head.meta.dtype][0])
        system, at = file_at(head.path)
        with system.open_input_file(at) as file:
            for r in range(*partition.rows):
                first, last = r * head.across + partition.cols[0], r * head.across + partition.cols[1]
                offsets, counts = (rasters.table_part(lambda a, n: file.read_at(n, a), head.order, e, first, last) for e in (head.offsets, head.counts))
                for c, offset, count in zip(range(*partition.cols), offsets, counts, strict=True):
                    rows = min(height, head.meta.height - r * height)
                    cols = min(width, head.meta.width - c * width)
                    y, x = head.row + r * height, head.col + c * width
                    cut = slice(max(0, self.window[0] - y), min(rows, self.window[1] - y)), slice(max(0, self.window[2] - x), min(cols, self.window[3] - x))
                    block = np.full((rows, cols), nodata)
                    if count:
                        z = decoded(file.read_at(count, offset), head)[:rows, :cols]
                        block[: len(z)] = z
                    z = block[cut]
                    if not z.size:
                        continue
                    row, col = np.divmod(np.arange(z.size), z.shape[1])
                    z = z.ravel()
                    values = pa.array(z.astype("f8" if self.kind == "double" else "f4"), kind, mask=(z == nodata) | (z != z))
                    yield pa.RecordBatch.from_arrays([pa.array(row + cut[0].start + y), pa.array(col + cut[1].start + x), values], ["row", "col", "z"])


@dataclass
class Put(WriterCommitMessage):
    blocks: int


class TiffWriter(DataSourceArrowWriter):
    """Puts blocks (block, at, content) into a file that lies ready; options as write_tiff gives them."""

    def __init__(self, options):
        self.aside, self.path = options["aside"], options["path"]
        self.offsets, self.counts, self.head = int(options["offsets"]), int(options["counts"]), bytes.fromhex(options["head"])

    def write(self, iterator) -> Put:
        n = 0
        with open(self.aside, "r+b") as out:
            for b in iterator:
                for block, at, content in zip(b.column("block").to_pylist(), b.column("at").to_pylist(), b.column("content"), strict=True):
                    data = content.as_py()
                    for place_, part in ((at, data), (self.offsets + 8 * block, struct.pack("<Q", at)), (self.counts + 8 * block, struct.pack("<Q", len(data)))):
                        os.pwrite(out.fileno(), part, place_)
                    n += 1
        return Put(n)

    def commit(self, messages) -> None:
        with open(self.aside, "r+b") as out:
            # the tables of a single block are numbers within the head
            cuts = sorted(x for x in (self.offsets, self.counts) if x < len(self.head))
            for a, b in zip([0, *(x + 8 for x in cuts)], [*cuts, len(self.head)], strict=True):
                os.pwrite(out.fileno(), self.head[a:b], a)
        os.replace(self.aside, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.aside):
            os.remove(self.aside)


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"row long, col long, z {rasters.value_type(rasters.needs_nodata(heads_of(self.options['path'])[0]))}"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["path"], schema["z"].dataType.simpleString())

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    return spark


def read_tiff(spark: SparkSession, path: str) -> tuple[DataFrame, RasterMeta]:
    """Cells (null for nodata) and metadata of a GeoTIFF, or of a folder of them; bounds of row and col choose blocks."""
    meta = rasters.needs_nodata(heads_of(path)[0])
    return registered(spark).read.format(FORMAT).load(path), meta


def big_head(meta: RasterMeta, block: int) -> tuple[bytes, int, int, int]:
    """(head of a tiled BigTIFF, places of its tables of offsets and of sizes, where blocks may begin)."""
    n = -(-meta.height // block) * -(-meta.width // block)
    tags = sorted([*rasters.image_tags(meta), (rasters.TILE_WIDTH, 4, (block,)), (rasters.TILE_HEIGHT, 4, (block,)), (rasters.TILE_OFFSETS, 16, None), (rasters.TILE_COUNTS, 16, None)], key=lambda t: t[0])
    more, body, entries, tables = 16 + 8 + 20 * len(tags) + 8, b"", b"", {}
    tail = sum(-(-len(rasters.tag_bytes(form, v)) // 8) * 8 for _, form, v in tags if v is not None and len(rasters.tag_bytes(form, v)) > 8)
    table = more + tail
    for k, (tag, form, values) in enumerate(tags):
        if values is None:
            tables[tag] = 16 + 8 + 20 * k + 12 if n == 1 else table
            entries += struct.pack("<HHQQ", tag, form, n, 0 if n == 1 else table)
            table += 0 if n == 1 else 8 * n
            continue
        packed = rasters.tag_bytes(form, values)
        count = len(packed) if form == 2 else len(values)
        if len(packed) <= 8:
            entries += struct.pack("<HHQ", tag, form, count) + packed.ljust(8, b"\0")
        else:
            entries += struct.pack("<HHQQ", tag, form, count, more + len(body))
            body += packed.ljust(-(-len(packed) // 8) * 8, b"\0")
    head = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(tags)) + entries + b"\0" * 8 + body
    return head, tables[rasters.TILE_OFFSETS], tables[rasters.TILE_COUNTS], table


def encoded(cells: DataFrame, meta: RasterMeta, value: str, block: int) -> DataFrame:
    """line, block, size, content: the blocks of cells, deflated; line is the row of blocks."""
    across, nodata, kind = -(-meta.width // block), meta.nodata, PIXEL_TYPES[meta.dtype][0]

    def run(tile_row: int, tile_col: int, table) -> list[dict]:
        import numpy as np

        rows, cols, _, _ = place(table, tile_row, tile_col, block)
        whole = np.full((block, block), 0 if nodata is None else nodata, "<" + kind)
        known = table.column("v").is_valid().to_numpy(zero_copy_only=False)
        whole[rows[known], cols[known]] = table.column("v").to_numpy()[known]
        content = zlib.compress(whole.tobytes())
        return [{"line": tile_row, "block": tile_row * across + tile_col, "size": len(content), "content": content}]

    inside = cells.where(F.col("row").between(0, meta.height - 1) & F.col("col").between(0, meta.width - 1))
    return each_tile(inside.select("row", "col", F.col(value).cast("double").alias("v")), block, run, "line long, block long, size long, content binary")


def write_tiff(cells: DataFrame, meta: RasterMeta, path: str, value: str = "z", block: int = BLOCK) -> None:
    """One tiled BigTIFF of cells (row, col, value) at path, which replaces what is there."""
    if block <= 0 or block % 16:
        raise ValueError("a block's edge must be a multiple of 16")
    system, target = file_at(path)
    if system.type_name != "local":
        raise ValueError("one file needs a path that all machines see as files; write a folder instead")
    spark = registered(cells.sparkSession)
    head, offsets, counts, data = big_head(meta, block)
    blocks = written(encoded(cells, meta, value, block), "blocks")
    lines = blocks.groupBy("line").agg(F.sum("size").alias("n"))
    before = lines.select("line", (F.sum("n").over(Window.orderBy("line")) - F.col("n") + data).alias("before"))  # a row for each row of blocks
    along = Window.partitionBy("line").orderBy("block")
    placed = blocks.join(before, "line").select("block", (F.col("before") + F.sum("size").over(along) - F.col("size")).alias("at"), "content")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    aside = f"{target}.{uuid.uuid4().hex}"
    with open(aside, "wb") as out:
        out.truncate(data)
    options = {"aside": aside, "path": target, "offsets": str(offsets), "counts": str(counts), "head": head.hex()}
    try:
        placed.write.format(FORMAT).mode("append").options(**options).save()
    finally:
        if os.path.exists(aside):
            os.remove(aside)
        discard(blocks)


def is_tiff(path: str) -> bool:
    return path.endswith((".tif", ".tiff"))
