"""Codes and steps of the eight directions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes, in whose order ties are broken, and their steps (rows grow southward).
NAMES = ("E", "NE", "N", "NW", "W", "SW", "S", "SE")
STEPS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
UNDEFINED = 8
NODATA = 9
ACCUMULATION_NODATA = -9999
TERMINATES = (-1, -1)
EXTERNAL = (-2, -2)
EPSILON_GRADIENT = 1e-5
DEFAULT_CHUNK_SIZE = 2000
DEFAULT_SEARCH_RADIUS = 200
DEFAULT_MAX_PITS = 24

DISTANCES = tuple(math.sqrt(2) if dr and dc else 1.0 for dr, dc in STEPS)


def step(code: Column, axis: int) -> Column:
    """Rows (axis 0) or columns (axis 1) that a direction code moves by; null for other codes."""
    return F.when(code.between(0, 7), F.element_at(F.array(*(F.lit(s[axis]) for s in STEPS)), (code + 1).cast("int")))
