"""Small grids with known results, and the operators' invariants."""

from __future__ import annotations

import numpy as np
import pytest

from thalweg.functions.d8 import STEPS
from thalweg.operators import accumulation, flats, grid, least_cost, pits
from thalweg.operators.flow_direction import flow_direction

NO = None


def cells(spark, rows, value="z", kind="float"):
    data = [(r, c, float(v) if v is not None and kind == "float" else v) for r, line in enumerate(rows) for c, v in enumerate(line)]
    return spark.createDataFrame(data, f"row long, col long, {value} {kind}")


def matrix(frame, value):
    found = {(r["row"], r["col"]): r[value] for r in frame.collect()}
    height, width = max(k[0] for k in found) + 1, max(k[1] for k in found) + 1
    return [[found[r, c] for c in range(width)] for r in range(height)]


def digits(text):
    return [[int(x) for x in line.split()] for line in text.strip().splitlines()]


def test_flow_direction(spark):
    dem = digits("5 4 3 2 1\n5 5 5 5 5\n5 5 5 5 5\n5 5 4 5 5\n5 5 5 5 5")
    want = digits("1 1 1 1 0\n3 1 1 2 0\n3 7 6 5 0\n3 0 8 4 0\n3 5 5 5 0")
    assert matrix(flow_direction(cells(spark, dem)), "fdr") == want


# Published examples and their results.
FDR = digits("2 2 2 2 2 2 2\n1 2 3 1 1 2 3\n2 2 2 1 2 2 3\n2 2 3 4 2 3 3\n4 2 2 3 3 4 4\n3 3 7 0 2 3 4\n3 7 0 1 2 2 4")
FAC = digits("1 27 1 1 2 11 1\n3 21 2 1 5 4 1\n2 20 1 1 3 2 1\n1 2 17 14 1 1 1\n2 1 1 1 13 2 1\n1 1 1 1 6 4 1\n1 1 1 3 1 2 1")


def test_flow_accumulation_and_links(spark):
    fdr = cells(spark, FDR, "fdr", "short")
    assert matrix(accumulation.flow_accumulation(fdr), "fac") == FAC
    found = {(r["row"], r["col"]): (r["link_row"], r["link_col"]) for r in accumulation.flow_links(fdr, 7, 7).collect()}
    want = {(0, c): (-2, -2) for c in range(7)} | {(r, 0): (0, 1) for r in (1, 2, 3)} | {(r, 0): (-2, -2) for r in (4, 5, 6)} | {(r, 6): (0, 5) for r in (1, 2, 3)}
    want |= {(r, 6): (0, 1) for r in (4, 5, 6)} | {(6, 1): (-2, -2)} | {(6, c): (0, 1) for c in (2, 3, 4, 5)}
    assert found == want


@pytest.mark.parametrize("tile", [1, 2, 3, 5])
def test_accumulation_does_not_depend_on_tiles(spark, tile):
    fdr = cells(spark, FDR, "fdr", "short")
    assert matrix(accumulation.flow_accumulation(fdr, tile), "fac") == FAC
    assert sorted(accumulation.flow_links(fdr, 7, 7, tile).collect()) == sorted(accumulation.flow_links(fdr, 7, 7).collect())


def test_tiles_by_themselves(spark):
    """Tiles of 3 x 3: their own sums, and where paths leave them."""
    fdr = cells(spark, FDR, "fdr", "short")
    own = matrix(accumulation.tile_accumulation(fdr, 3), "fac")
    links = {(r["row"], r["col"]): (r["link_row"], r["link_col"]) for r in accumulation.tile_links(fdr, 3).collect()}
    for y, x in ((0, 0), (0, 3), (3, 0), (3, 3), (6, 6), (3, 6)):
        part = [(r, c) for r in range(y, min(y + 3, 7)) for c in range(x, min(x + 3, 7))]
        for cell in part:
            upstream = 0
            for at in part:
                seen = set()
                while at in part and at not in seen:
                    seen.add(at)
                    dr, dc = STEPS[FDR[at[0]][at[1]]]
                    at = (at[0] + dr, at[1] + dc)
                upstream += cell in seen
            assert own[cell[0]][cell[1]] == upstream
            at, last = cell, cell
            while at in part:
                last, (dr, dc) = at, STEPS[FDR[at[0]][at[1]]]
                at = (at[0] + dr, at[1] + dc)
            if cell in links:
                assert links[cell] == ((-2, -2) if last == cell else last)


def test_accumulation_with_nodata_sinks_and_cycles(spark):
    assert matrix(accumulation.flow_accumulation(cells(spark, [[0, 0, 8, 9, 4]], "fdr", "short")), "fac") == [[1, 2, 3, -9999, 1]]
    with pytest.raises(ValueError, match="cycle"):
        accumulation.flow_accumulation(cells(spark, [[0, 4]], "fdr", "short")).collect()


FLAT = [[1] * 7, *[[1, 0, 0, 0, 0, 0, 1]] * 5, [1, 1, -1, 1, 1, 1, 1]]


def test_flats(spark):
    dem = cells(spark, FLAT)
    fdr = flow_direction(dem)
    # the outer ring drains inwards here, as it does within a larger raster
    ring = digits("7 6 6 6 6 6 5\n0 8 8 8 8 8 4\n0 8 8 8 8 8 4\n0 8 8 8 8 8 4\n0 8 8 8 8 8 4\n0 7 6 5 8 8 4\n1 2 6 2 2 2 3")
    fdr = cells(spark, ring, "fdr", "short")
    kinds = {(r["row"], r["col"]): r["kind"] for r in flats.flat_edges(dem, fdr).collect()}
    assert sorted(p for p, k in kinds.items() if k == "low") == [(5, 1), (5, 2), (5, 3)] and sum(k == "high" for k in kinds.values()) == 13
    mask = flats.flat_mask(dem, fdr)
    inner = digits("12 12 12 12 12\n10 9 9 9 10\n8 7 6 7 8\n6 5 5 5 8\n2 2 2 6 8")
    assert [r[1:6] for r in matrix(mask, "flat_mask")[1:6]] == inner
    away = digits("1 1 1 1 1\n1 2 2 2 1\n1 2 3 2 1\n1 2 2 2 1\n0 0 0 1 1")
    assert [r[1:6] for r in matrix(mask, "away")[1:6]] == away
    drained = matrix(flats.flat_flow_direction(mask, fdr), "fdr")
    assert [r[1:6] for r in drained[1:6]] == digits("7 6 6 6 5\n7 7 6 5 5\n7 6 6 6 5\n6 6 6 5 4\n7 6 5 4 3")
    assert drained[0] == ring[0] and drained[6] == ring[6]


@pytest.mark.parametrize("tile", [2, 3, 5])
def test_flats_do_not_depend_on_tiles(spark, tile):
    r = np.random.default_rng(4)
    dem = cells(spark, np.where(r.random((13, 17)) < 0.1, None, r.integers(0, 3, (13, 17)).astype(float)).tolist())
    fdr = flow_direction(dem)
    edges = flats.flat_edges(dem, fdr)
    assert sorted(flats.flat_labels(dem, edges, tile).collect()) == sorted(flats.flat_labels(dem, edges).collect()) != []
    assert sorted(flats.flat_mask(dem, fdr, tile).collect()) == sorted(flats.flat_mask(dem, fdr).collect())


def test_undrainable_flats_keep_their_code(spark):
    dem = cells(spark, [[2] * 5, [2, 1, 1, 1, 2], [2] * 5])
    fdr = cells(spark, [[7] * 5, [0, 8, 8, 8, 4], [1] * 5], "fdr", "short")
    mask = flats.flat_mask(dem, fdr)
    assert matrix(flats.flat_flow_direction(mask, fdr), "fdr")[1][1:4] == [8, 8, 8]
    assert flats.flat_report(mask, fdr).first()["undrainable"] == 3


def test_neighbours_of_one_raster_whatever_its_tiles(spark):
    z = np.random.default_rng(1).integers(0, 9, (17, 23)).tolist()
    found = [sorted(map(str, grid.neighbours(cells(spark, z), "z", size=s).collect())) for s in (3, 7, 64)]
    assert found[0] == found[1] == found[2]


def pit_dem(n=5):
    dem = np.full((n, n), 2.0)
    dem[1, 0], dem[2, 2] = -1, 0
    return dem


def test_single_cell_pits(spark):
    frame = np.full((9, 9), np.nan)
    frame[2:7, 2:7] = pit_dem()
    rows = [[None if np.isnan(v) else float(v) for v in line] for line in frame]
    found = np.array(matrix(pits.breach_single_cell_pits(cells(spark, rows), nodata=-999.0, chunk_size=9), "z"), dtype=float)
    want = frame.copy()
    want[4, 3] = -0.5
    assert np.array_equal(found, want, equal_nan=True)
    epsilon = pits.breach_single_cell_pits(cells(spark, rows), nodata=-999.0, nodata_outlet="epsilon")
    assert np.array_equal(np.array(matrix(epsilon, "z"), dtype=float), want, equal_nan=True)


@pytest.mark.parametrize(("outlet", "one", "two"), [(-2.0, -4 / 3, -2 / 3), (NO, -2e-5, -1e-5)])
@pytest.mark.parametrize("tile", [3, 64])
def test_least_cost(spark, outlet, one, two, tile):
    dem = [[2.0] * 7 for _ in range(7)]
    dem[3][3], dem[0][3] = 0.0, outlet
    found = matrix(least_cost.breach_paths_least_cost(cells(spark, dem), radius=3, tile=tile), "z")
    want = [list(line) for line in dem]
    want[1][3], want[2][3] = one, two
    assert [[v is None for v in line] for line in found] == [[v is None for v in line] for line in want]
    assert np.allclose(np.array(found, dtype=float), np.array(want, dtype=float), equal_nan=True)


def test_least_cost_does_not_depend_on_tiles(spark):
    z = np.random.default_rng(0).uniform(1, 10, (24, 24)).astype("f4").tolist()
    found = [matrix(least_cost.breach_paths_least_cost(cells(spark, z), radius=4, tile=t), "z") for t in (5, 64)]
    assert found[0] == found[1] != z
    assert np.all((np.array(found[0]) <= np.array(z))[2:-2, 2:-2])
    with pytest.raises(ValueError):
        least_cost.breach_paths_least_cost(cells(spark, z), radius=0)


def test_windows(spark):
    z = cells(spark, np.arange(100).reshape(10, 10).tolist())
    found = matrix(grid.window(z, 8, 8, 4, 4).selectExpr("row - 8 AS row", "col - 8 AS col", "z"), "z")
    assert [line[:2] for line in found[:2]] == [[88, 89], [98, 99]] and found[2] == [None] * 4 and grid.window(z, 20, 20, 2, 2).where("z is null").count() == 4
    assert grid.window(z, 0, 0, 0, 5).count() == 0
    with pytest.raises(ValueError):
        grid.window(z, 0, 0, -1, 5)


def test_halos_and_cores(spark):
    z = cells(spark, np.arange(100).reshape(10, 10).tolist())
    tiled = grid.with_halo(z, 4, 2)
    assert tiled.where("tile_row = 1 and tile_col = 1").count() == 64 and tiled.where("tile_row = 2 and tile_col = 2").count() == 16
    assert sorted(map(tuple, grid.core(tiled, 4).select("row", "col", "z").collect())) == sorted(map(tuple, z.collect()))


def test_nan_and_nodata_become_null(spark):
    z = spark.createDataFrame([(0, 0, float("nan")), (0, 1, -9999.0), (0, 2, 1.0)], "row long, col long, z double")
    assert matrix(grid.normalise(z, -9999.0), "z") == [[None, None, 1.0]]
