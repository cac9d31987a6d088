"""Directions that run in cycles: found within tiles and across them."""

from __future__ import annotations

import numpy as np
import pytest

from thalweg.functions.d8 import STEPS
from thalweg.operators.accumulation import flow_accumulation, flow_cycles, flow_links


def directions(spark, codes):
    return spark.createDataFrame([(r, c, int(codes[r, c])) for r in range(codes.shape[0]) for c in range(codes.shape[1])], "row long, col long, fdr short")


def plain_cycles(codes):
    height, width = codes.shape

    def following(cell):
        code = codes[cell]
        if code > 7:
            return None
        to = cell[0] + STEPS[code][0], cell[1] + STEPS[code][1]
        return to if 0 <= to[0] < height and 0 <= to[1] < width and codes[to] != 9 else None

    found = set()
    for start in np.ndindex(codes.shape):
        path, cell = [start], following(start)
        while cell and cell not in path:
            path.append(cell)
            cell = following(cell)
        if cell == start:
            found.add((*start, *min(path), len(path)))
    return found


@pytest.mark.parametrize("tile", [2, 5, 512])
def test_cycles_equal_plain_ones(spark, tile):
    codes = np.random.default_rng(3).integers(0, 10, (18, 21))
    ring = [(r, 2) for r in range(3, 15)] + [(15, c) for c in range(2, 17)] + [(r, 17) for r in range(15, 3, -1)] + [(3, c) for c in range(17, 2, -1)]
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        codes[a] = STEPS.index((b[0] - a[0], b[1] - a[1])) if a != b else codes[a]
    found = {tuple(r) for r in flow_cycles(directions(spark, codes), tile).collect()}
    wanted = plain_cycles(codes)
    assert found == wanted and max(x[4] for x in wanted) > 40 and min(x[4] for x in wanted) == 2


@pytest.mark.parametrize("tile", [1, 4])
def test_cycles_are_reported(spark, tile):
    codes = np.full((4, 4), 8)
    codes[1, 1], codes[1, 2] = 0, 4
    fdr = directions(spark, codes)
    for operator in (lambda: flow_accumulation(fdr, tile), lambda: flow_links(fdr, 4, 4, tile)):
        with pytest.raises(ValueError, match="cycle .*1, .*1|cycle .*1, .*2"):
            operator().collect()
    assert {tuple(r) for r in flow_cycles(fdr, tile).collect()} == {(1, 1, 1, 1, 2), (1, 2, 1, 1, 2)}


def test_no_cycles(spark):
    codes = np.zeros((3, 5), int)
    assert flow_cycles(directions(spark, codes), 2).collect() == []
    assert flow_cycles(directions(spark, codes).limit(0), 2).collect() == []
