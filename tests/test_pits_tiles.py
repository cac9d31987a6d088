"""Single-cell breaching by tiles against one pass over the whole raster, with pits that depend on one another."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_raster_tiles import cells_of, rows_of, terrain
from thalweg.operators import pits
from thalweg.operators.pits import HALO, RING, breach_array, breach_single_cell_pits, pits_of


def plain(z, nodata=-9999.0, epsilon=None):
    """The rule cell by cell, on a raster with nodata all around."""
    wide = np.pad(z, HALO, constant_values=np.nan)
    found = np.zeros(wide.shape, bool)
    for r, c in pits_of(wide).tolist():
        own, solved = wide[r, c], False
        for (dr, dc), (er, ec) in RING:
            far = wide[r + dr, c + dc]
            if np.isnan(far) or far <= own:
                solved = True
                new = (own + far) / 2 if not np.isnan(far) else own - np.float32(epsilon) if epsilon else (float(own) + nodata) / 2
                wide[r + er, c + ec] = np.nan if new == nodata else new
        found[r, c] = not solved
    core = slice(HALO, -HALO), slice(HALO, -HALO)
    return wide[core], found[core]


def dense(height, width, seed):
    """Noise, in which a tenth of the cells are pits and most depend on others; ties, and some nodata."""
    return terrain(height, width, seed, levels=40, gaps=0.01)


def as_arrays(found, shape):
    z, pit = np.full(shape, np.nan, "f4"), np.zeros(shape, bool)
    for r, c, v, p in found.collect():
        z[r, c], pit[r, c] = np.nan if v is None else v, p
    return z, pit


@pytest.mark.parametrize(("size", "seed"), [(2, 1), (3, 2), (5, 3), (16, 4), (512, 5)])
def test_tiles_give_what_one_pass_gives(spark, size, seed):
    z = dense(33, 29, seed)
    found = as_arrays(breach_single_cell_pits(cells_of(spark, z), tile=size), z.shape)
    wanted = plain(z)
    assert np.array_equal(found[0], wanted[0], equal_nan=True) and np.array_equal(found[1], wanted[1])
    assert pits_of(np.pad(z, 2, constant_values=np.nan)).shape[0] > 60


def test_changes_travel_through_tiles(spark, monkeypatch):
    """Later pits see earlier ones' changes: an order that ignores that gives another raster, and more than one round is needed."""
    z = dense(40, 40, 7)
    names = []
    real = pits.written
    monkeypatch.setattr(pits, "written", lambda df, name: names.append(name) or real(df, name))
    found = as_arrays(breach_single_cell_pits(cells_of(spark, z), tile=4), z.shape)
    assert np.array_equal(found[0], plain(z)[0], equal_nan=True)
    assert "edits-1" in names
    apart = as_arrays(breach_single_cell_pits(cells_of(spark, z), chunk_size=4), z.shape)
    assert not np.array_equal(apart[0], found[0], equal_nan=True)


@pytest.mark.parametrize(("chunk", "tile"), [(2, 512), (7, 4), (12, 4), (12, 5), (100, 8)])
def test_chunks_are_breached_each_on_its_own(spark, chunk, tile):
    z = dense(26, 31, 9)
    wide, wanted, left = np.pad(z, HALO, constant_values=np.nan), np.zeros(z.shape, "f4"), np.zeros(z.shape, bool)
    for r in range(0, 26, chunk):
        for c in range(0, 31, chunk):
            own = wide[r : r + chunk + 2 * HALO, c : c + chunk + 2 * HALO].copy()
            places, _ = breach_array(own, -9999.0)
            wanted[r : r + chunk, c : c + chunk] = own[HALO:-HALO, HALO:-HALO]
            for a, b in places:
                left[r + a - HALO, c + b - HALO] = True
    found = as_arrays(breach_single_cell_pits(cells_of(spark, z), chunk_size=chunk, tile=tile), z.shape)
    assert np.array_equal(found[0], wanted, equal_nan=True) and np.array_equal(found[1], left)


@pytest.mark.parametrize("epsilon", [None, 1e-5])
def test_arrays_equal_the_plain_rule(epsilon):
    for seed in range(6):
        z = dense(24, 24, seed)
        wide = np.pad(z, HALO, constant_values=np.nan)
        left, _ = breach_array(wide, -9999.0, epsilon)
        wanted = plain(z, epsilon=epsilon)
        assert np.array_equal(wide[HALO:-HALO, HALO:-HALO], wanted[0], equal_nan=True)
        assert left.tolist() == (np.argwhere(wanted[1]) + HALO).tolist()


def test_epsilon_and_left_out_cells(spark):
    z = dense(20, 20, 3)
    gone = {(0, 0), (7, 7), (19, 19), (4, 16)}
    held = z.copy()
    for r, c in gone:
        held[r, c] = np.nan
    found = breach_single_cell_pits(cells_of(spark, z, gone), nodata_outlet="epsilon", tile=6)
    wanted = plain(held, epsilon=1e-5)
    assert found.count() == 396 and found.where("row = 7 and col = 7").count() == 0
    for r, c, v, p in found.collect():
        assert (v is None) == np.isnan(wanted[0][r, c]) and (v is None or v == wanted[0][r, c]) and p == wanted[1][r, c]


def test_no_cells_and_bad_sizes(spark):
    cells = cells_of(spark, dense(4, 4, 1))
    assert breach_single_cell_pits(cells.limit(0)).collect() == []
    nothing = cells.withColumn("z", F.lit(None).cast("float"))
    assert rows_of(breach_single_cell_pits(nothing)) == [(r, c, None, False) for r in range(4) for c in range(4)]
    for bad in ({"chunk_size": 1}, {"chunk_size": 0}, {"tile": 1}, {"nodata_outlet": "none"}):
        with pytest.raises(ValueError):
            breach_single_cell_pits(cells, **bad)
