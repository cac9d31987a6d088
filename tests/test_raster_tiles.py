"""Rasters as array tiles: strips, independence of tiles, what is shuffled and written."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions.d8 import UNDEFINED
from thalweg.operators import flats
from thalweg.operators.flow_direction import flow_direction, raster_directions
from thalweg.operators.raster import KEY, each, padded, to_cells, to_raster, with_strips
from thalweg.plans.drainage import drainage


def terrain(height, width, seed, levels=4, gaps=0.05):
    r = np.random.default_rng(seed)
    z = r.integers(0, levels, (height, width)).astype("f4")
    z[r.random(z.shape) < gaps] = np.nan
    return z


def cells_of(spark, z, left_out=()):
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1]) if (r, c) not in left_out]
    return spark.createDataFrame(rows, "row long, col long, z float")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("halo", "size"), [(1, 1), (1, 4), (2, 5), (3, 3), (2, 64)])
def test_strips_are_what_lies_around_a_tile(spark, halo, size):
    z = terrain(13, 11, 1)
    raster = to_raster(cells_of(spark, z), size)
    types = raster.types()
    wide = each(with_strips(raster, ("z", "there"), halo), lambda t: {"tile_row": t["tile_row"], "tile_col": t["tile_col"], "z": padded(t, "z", types, size, halo).tobytes(), "there": padded(t, "there", types, size, halo).tobytes()}, "tile_row long, tile_col long, z binary, there binary")
    around = np.pad(z, halo, constant_values=np.nan)
    inside = np.pad(np.ones(z.shape, bool), halo)
    found = wide.collect()
    assert len(found) == -(-13 // size) * -(-11 // size)
    for t in found:
        r, c = t["tile_row"] * size, t["tile_col"] * size
        shape = min(size, 13 - r) + 2 * halo, min(size, 11 - c) + 2 * halo
        at = slice(r, r + shape[0]), slice(c, c + shape[1])
        assert np.array_equal(np.frombuffer(t["z"], "f4").reshape(shape), around[at], equal_nan=True)
        assert np.array_equal(np.frombuffer(t["there"], bool).reshape(shape), inside[at])


@pytest.mark.parametrize("size", [1, 4, 64])
def test_directions_equal_those_of_cells(spark, size):
    cells = cells_of(spark, terrain(12, 17, 2), {(0, 0), (5, 5), (11, 3), (11, 16), (4, 7)})
    assert rows_of(to_cells(raster_directions(to_raster(cells, size)), "fdr")) == rows_of(flow_direction(cells))


def test_double_and_whole_elevations(spark):
    big = cells_of(spark, terrain(6, 6, 3)).select("row", "col", (F.col("z").cast("long") + 2**40).alias("z"))
    assert rows_of(to_cells(raster_directions(to_raster(big, 4)), "fdr")) == rows_of(flow_direction(big))
    assert rows_of(to_cells(to_raster(big, 4), "z")) == rows_of(big.select("row", "col", F.col("z").cast("double")))


@pytest.mark.parametrize("strict", [True, False])
def test_flats_do_not_depend_on_tiles(spark, strict):
    cells = cells_of(spark, terrain(24, 21, 5, levels=2), {(3, 3), (23, 20), (10, 0)})
    fdr = flow_direction(cells)
    whole = flats.flat_mask(cells, fdr, 512)
    found = rows_of(whole)
    drained = rows_of(flats.flat_flow_direction(whole, fdr, strict))
    assert any(r[2] > 0 for r in found)
    for size in (5, 8):
        mask = flats.flat_mask(cells, fdr, size)
        assert rows_of(mask) == found
        assert rows_of(flats.flat_flow_direction(mask, fdr, strict, size)) == drained


def test_a_round_writes_the_tiles_that_change(spark, monkeypatch):
    """A lake 14 tiles long with its outlet at one end: each round reaches the next tile, and writes few."""
    z = np.full((6, 70), 5.0, "f4")
    z[0], z[-1], z[:, -1] = 9, 9, 9
    z[2, 0] = 1
    sizes = {}
    real = flats.written

    def counted(df, name):
        table = real(df, name)
        if name.startswith("flats-"):
            sizes[name] = table.count()
        return table

    monkeypatch.setattr(flats, "written", counted)
    monkeypatch.setattr(flats, "ROUNDS_APART", 5)
    cells = cells_of(spark, z)
    fdr = flow_direction(cells).cache()
    found = flats.flat_mask(cells, fdr, 5)
    assert sizes["flats-0"] == 28
    rounds = [n for k, n in sizes.items() if k.removeprefix("flats-").isdigit() and k != "flats-0"]
    assert 12 <= len(rounds) <= 17 and max(rounds[3:]) <= 6
    assert any(k.startswith("flats-to-") for k in sizes)
    monkeypatch.undo()
    assert rows_of(found) == rows_of(flats.flat_mask(cells, fdr, 512))
    assert fdr.where(F.col("fdr") == UNDEFINED).count() > 200


def stages(spark):
    """id -> records that a stage's tasks wrote for a shuffle."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}


def test_drainage_shuffles_cells_once(spark):
    z = terrain(150, 160, 8, levels=9)
    cells = cells_of(spark, z).cache()
    cells.count()
    last = max(stages(spark))
    found = drainage(cells, tile=64).cells().collect()
    sent = sum(n for k, n in stages(spark).items() if k > last)
    assert len(found) == z.size
    # all else are rows of tiles, of strips and of borders
    assert z.size <= sent < 1.35 * z.size


def test_drainage_does_not_depend_on_tiles(spark):
    cells = cells_of(spark, terrain(30, 26, 9, levels=3), {(7, 7), (29, 25)})
    assert rows_of(drainage(cells, tile=7).cells()) == rows_of(drainage(cells).cells())
    made = drainage(cells, tile=9)
    assert made.fac.count() == made.dem.count() == made.fdr.count() == made.mask.count() == 30 * 26 - 2


def test_no_cells(spark):
    cells = cells_of(spark, terrain(2, 2, 1)).limit(0)
    assert drainage(cells).cells().collect() == []
    assert KEY == ["tile_row", "tile_col"]


@pytest.mark.parametrize("name", ["downstream_edges", "inflow_count", "flat_edges", "flat_labels", "flat_mask", "flow_cycles", "drainage_tiles"])
def test_no_raster_is_broadcast(spark, sf_dir, monkeypatch, name):
    """Small as a raster's files are, its joins are shuffled: decoded, 6 GB of cells would fill a task and the driver."""
    from thalweg.operators import accumulation, flats
    from thalweg.plans import drainage, queries

    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (accumulation, drainage, flats, queries):
        for write in {"written", "written_tiles"} & vars(module).keys():
            monkeypatch.setattr(module, write, lambda df, n, real=getattr(module, write): real(noted(df), n))
    noted(queries.queries()[name](spark, sf_dir))
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]


def test_python_workers_get_few_tiles_at_once(spark, tmp_path, monkeypatch):
    """drainage_breached: each tile of 8 MB is a batch of its own, where Spark's limit lets 8 pass at once."""
    from thalweg.operators import pits
    from thalweg.plans import drainage as plan

    def noted(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows]})

    tiles = spark.range(6, numPartitions=1).selectExpr("encode(repeat('x', 8000000), 'utf-8') as z")
    for module in (pits, flats, plan):
        made = module.written_tiles(tiles.mapInArrow(noted, "rows long"), "noted")
        assert {r["rows"] for r in made.collect()} == {1}
    assert {r["rows"] for r in tiles.mapInArrow(noted, "rows long").collect()} == {6}


def test_tasks_that_find_neighbours_grow_in_number(spark, monkeypatch):
    from thalweg.operators import grid

    monkeypatch.setattr(grid, "STENCIL_CELLS", 50, raising=False)
    cells = spark.range(30 * 40).selectExpr("id div 40 as row", "id % 40 as col", "id as z")
    found = grid.neighbours(cells, size=8)
    assert "hashpartitioning(tile_row#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 24), REPARTITION_BY_NUM" in plan
    assert found.count() == 1200
