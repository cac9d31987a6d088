"""The registered queries of the raster operators, and their SQL for DuckDB.

The table of embeddings is a dense matrix; as a raster, row = vec_id, column = place in
the vector, z = floor(value * K), in whole numbers so that ties are the same everywhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions.d8 import DEFAULT_SEARCH_RADIUS
from thalweg.operators import accumulation, flats, grid, least_cost, pits
from thalweg.operators.flow_direction import flow_direction, neighbour_slopes, raster_directions
from thalweg.operators.raster import to_cells, to_raster
from thalweg.plans.drainage import drainage
from thalweg.session import shared_dir, written
from thalweg.sources import geotiff, rasters

FINE, COARSE, TILT, HIDDEN = 1000, 20, 200, 0.35
#: A scale at which hardly two paths cost the same.
FINEST = 1_000_000
#: The radius of searches that SQL follows step by step.
NEAR = 12
CHUNK = 48


def dem(spark: SparkSession, sf_dir: str, scale: int = FINE, tilt: int = 0, hide: float | None = None) -> DataFrame:
    """row, col, z of the embeddings; values above hide are nodata."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    z = F.floor(F.col("v").cast("double") * scale) + tilt * F.col("row")
    return rows.select("row", F.col("col").cast("long").alias("col"), F.when(F.col("v").cast("double") <= hide, z).alias("z") if hide is not None else z.alias("z"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane with one cell of each 8 x 8 lowered by 12 to 39, as values have it."""
    cells = dem(spark, sf_dir)
    low = (F.col("row") % 8 == 4) & (F.col("col") % 8 == 4)
    return cells.select("row", "col", (10 * F.col("row") + F.col("col") - F.when(low, 12 + F.pmod("z", F.lit(28))).otherwise(0)).cast("float").alias("z"))


def dem_cells(spark, sf_dir):
    return dem(spark, sf_dir)


def window_read_oob(spark, sf_dir):
    return grid.window(dem(spark, sf_dir), -5, 50, 40, 30)


def chunk_index(spark, sf_dir):
    return grid.chunk_index(*grid.extent(dem(spark, sf_dir)), CHUNK, spark)


def chunk_halo_counts(spark, sf_dir):
    tiled = grid.with_halo(dem(spark, sf_dir), CHUNK, 2)
    return tiled.groupBy("tile_row", "tile_col").agg(F.count("*").alias("cells"), F.sum("z").alias("total"))


def chunk_core_roundtrip(spark, sf_dir):
    return grid.core(grid.with_halo(dem(spark, sf_dir), CHUNK, 2), CHUNK).select("row", "col", "z")


def neighbor_slopes(spark, sf_dir):
    return neighbour_slopes(dem(spark, sf_dir)).select("row", "col", "code", F.when(F.col("slope") < float("inf"), F.col("slope")).alias("slope"))


def flow_direction_(spark, sf_dir):
    return flow_direction(dem(spark, sf_dir))


def flow_direction_nodata(spark, sf_dir):
    return flow_direction(dem(spark, sf_dir, hide=HIDDEN))


def _tilted(spark, sf_dir):
    return written(flow_direction(dem(spark, sf_dir, tilt=TILT)), "fdr")


def downstream_edges(spark, sf_dir):
    return accumulation.edges(_tilted(spark, sf_dir)).where("to_fdr is not null").select("row", "col", "to_row", "to_col")


def inflow_count(spark, sf_dir):
    return accumulation.inflow_count(_tilted(spark, sf_dir))


def tile_perimeter(spark, sf_dir):
    cells = dem(spark, sf_dir)
    return cells.where(accumulation.perimeter(*grid.extent(cells))).select("row", "col")


def flow_accumulation(spark, sf_dir):
    return accumulation.flow_accumulation(_tilted(spark, sf_dir))


def flow_links(spark, sf_dir):
    fdr = _tilted(spark, sf_dir)
    return accumulation.flow_links(fdr, *grid.extent(fdr))


def _flat(spark, sf_dir):
    cells = written(dem(spark, sf_dir, COARSE), "dem")
    return cells, written(flow_direction(cells), "fdr")


def tile_accumulation(spark, sf_dir):
    return accumulation.tile_accumulation(_tilted(spark, sf_dir), CHUNK)


def tile_links(spark, sf_dir):
    return accumulation.tile_links(_tilted(spark, sf_dir), CHUNK)


def flow_cycles(spark, sf_dir):
    """Directions that may run in cycles: flats without an outlet take the first neighbour of the least slope."""
    cells, fdr = _flat(spark, sf_dir)
    return accumulation.flow_cycles(flats.flat_flow_direction(flats.flat_mask(cells, fdr), fdr, strict=False), CHUNK)


def flat_edges(spark, sf_dir):
    return flats.flat_edges(*_flat(spark, sf_dir))


def flat_labels(spark, sf_dir):
    cells, fdr = _flat(spark, sf_dir)
    return flats.flat_labels(cells, flats.flat_edges(cells, fdr))


def flat_away(spark, sf_dir):
    return flats.flat_mask(*_flat(spark, sf_dir)).where("away > 0").select("row", "col", "away")


def flat_lower(spark, sf_dir):
    return flats.flat_mask(*_flat(spark, sf_dir)).where("low > 0").select("row", "col", "low")


def flat_mask(spark, sf_dir):
    return flats.flat_mask(*_flat(spark, sf_dir)).select("row", "col", "label", "flat_mask")


def flat_flow_direction(spark, sf_dir):
    elevations = to_raster(dem(spark, sf_dir, COARSE))
    first = elevations.with_table(written(elevations.table, "elevations"))
    first = raster_directions(first)
    found = flats.raster_flats(first.with_table(written(first.table, "directions")))
    return to_cells(flats.raster_drained(found.with_table(written(found.table, "flats"))), "fdr")


def single_cell_pits(spark, sf_dir):
    return pits.single_cell_pits(dem(spark, sf_dir))


def breach_single_cell_pits(spark, sf_dir):
    return pits.breach_single_cell_pits(lattice(spark, sf_dir)).withColumn("z", F.col("z").cast("double"))


def breach_dense_pits(spark, sf_dir):
    """Noise, in which most pits depend on what earlier ones changed."""
    return pits.breach_single_cell_pits(dem(spark, sf_dir), tile=CHUNK).withColumn("z", F.col("z").cast("double"))


def breach_paths_least_cost(spark, sf_dir):
    return least_cost.breach_paths_least_cost(dem(spark, sf_dir))


def least_cost_paths(spark, sf_dir):
    """Elevations so fine that no two paths cost the same: then the result doesn't depend on how a heap orders equals."""
    return least_cost.breach_paths_least_cost(dem(spark, sf_dir, FINEST), radius=NEAR, tile=CHUNK).withColumn("z", F.col("z").cast("double"))


def drainage_pipeline(spark, sf_dir):
    return drainage(dem(spark, sf_dir, COARSE, tilt=1)).cells().select("row", "col", "fdr", "fac")


def drainage_tiles(spark, sf_dir):
    """The whole chain over small tiles, which exchange strips of their borders."""
    return drainage(dem(spark, sf_dir, COARSE, tilt=1, hide=HIDDEN), tile=CHUNK).cells().select("row", "col", "fdr", F.greatest("label", F.lit(0)).alias("label"), "flat_mask", "fac")


def drainage_breached(spark, sf_dir):
    return drainage(dem(spark, sf_dir), radius=DEFAULT_SEARCH_RADIUS).cells().select("row", "col", "z", "fdr", "fac")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/thalweg/{uuid.uuid4().hex}/{name}"


def _filed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, rasters.RasterMeta]:
    cells = written(dem(spark, sf_dir, hide=HIDDEN), "dem")
    height, width = grid.extent(cells)
    return cells.withColumn("z", F.col("z").cast("float")), rasters.RasterMeta(width, height)


def parquet_roundtrip(spark, sf_dir):
    cells, meta = _filed(spark, sf_dir)
    path = _folder(spark, "cells")
    rasters.write_cells(cells.fillna(meta.nodata), meta, path)
    return rasters.read_cells(spark, path)[0].select("row", "col", F.col("z").cast("long").alias("z"))


def ascii_roundtrip(spark, sf_dir):
    cells, meta = _filed(spark, sf_dir)
    path = _folder(spark, "grid.asc")
    rasters.write_ascii(cells, meta, path)
    return rasters.read_ascii(spark, path)[0].select("row", "col", F.col("z").cast("long").alias("z"))


def _tiff(spark, sf_dir):
    cells, meta = _filed(spark, sf_dir)
    path = _folder(spark, "grid.tif")
    geotiff.write_tiff(cells, meta, path, block=32)
    return geotiff.read_tiff(spark, path)[0].select("row", "col", F.col("z").cast("long").alias("z"))


def tiff_roundtrip(spark, sf_dir):
    return _tiff(spark, sf_dir)


def tiff_window(spark, sf_dir):
    return grid.window(_tiff(spark, sf_dir), -5, 50, 40, 30)


def queries() -> dict:
    found = (
        drainage_pipeline, dem_cells, window_read_oob, chunk_index, chunk_halo_counts, chunk_core_roundtrip, neighbor_slopes, flow_direction_, flow_direction_nodata,
        downstream_edges, inflow_count, tile_perimeter, flow_accumulation, flow_links, tile_accumulation, tile_links, flow_cycles, flat_edges, flat_labels, flat_away, flat_lower, flat_mask, flat_flow_direction,
        single_cell_pits, breach_single_cell_pits, breach_dense_pits, breach_paths_least_cost, least_cost_paths, drainage_tiles, drainage_breached, parquet_roundtrip, ascii_roundtrip, tiff_roundtrip, tiff_window,
    )
    return {f.__name__.rstrip("_"): f for f in found}


def _cells_sql(scale: int = FINE, tilt: int = 0, hide: float | None = None) -> str:
    z = f"CAST(floor(CAST(v AS DOUBLE) * {scale}) AS BIGINT) + {tilt} * r"
    if hide is not None:
        z = f"CASE WHEN CAST(v AS DOUBLE) <= {hide} THEN {z} END"
    return f"""vs AS (SELECT vec_id AS r, unnest(generate_series(1, len(embedding))) - 1 AS c, unnest(embedding) AS v FROM embeddings),
cells AS MATERIALIZED (SELECT r, c, {z} AS z FROM vs),
steps(k, dr, dc) AS (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1)),
near AS MATERIALIZED (SELECT a.r, a.c, a.z, k, dr, dc, b.r AS nr, b.c AS nc, b.z AS nz, CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0) ELSE 1.0 END AS dist
  FROM cells a CROSS JOIN steps LEFT JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc)"""


_FDR = """slopes AS (SELECT r, c, k, CASE WHEN nz IS NULL THEN CAST('infinity' AS DOUBLE) ELSE CAST(z - nz AS DOUBLE) / dist END AS slope FROM near WHERE z IS NOT NULL),
fdr AS MATERIALIZED (SELECT r, c, CASE WHEN slope > 0 THEN k ELSE 8 END AS d FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY slope DESC, k) AS n FROM slopes) WHERE n = 1
  UNION ALL SELECT r, c, 9 FROM cells WHERE z IS NULL),
flow AS MATERIALIZED (SELECT f.r, f.c, f.d, CASE WHEN f.d < 8 THEN f.r + dr END AS nr, CASE WHEN f.d < 8 THEN f.c + dc END AS nc, g.d AS nd
  FROM fdr f LEFT JOIN steps ON k = f.d LEFT JOIN fdr g ON f.d < 8 AND g.r = f.r + dr AND g.c = f.c + dc)"""

_EDGES = """kinds AS MATERIALIZED (SELECT n.r, n.c, CASE WHEN any_value(f.d) < 8 AND bool_or(coalesce(g.d = 8 AND n.nz = n.z, false)) THEN 'low' WHEN any_value(f.d) = 8 AND bool_or(coalesce(n.nz > n.z AND g.d <> 9, false)) THEN 'high' END AS kind
  FROM near n JOIN fdr f ON f.r = n.r AND f.c = n.c LEFT JOIN fdr g ON g.r = n.nr AND g.c = n.nc GROUP BY n.r, n.c)"""

_LABELS = """reach(sr, sc, r, c) AS (SELECT r, c, r, c FROM kinds WHERE kind = 'low' UNION SELECT q.sr, q.sc, n.nr, n.nc FROM reach q JOIN near n ON n.r = q.r AND n.c = q.c AND n.nz = n.z),
firsts AS MATERIALIZED (SELECT r, c, min({'r': sr, 'c': sc}) AS first FROM reach GROUP BY r, c),
labels AS MATERIALIZED (SELECT r, c, dense_rank() OVER (ORDER BY first) AS label FROM firsts)"""

_DISTANCES = """flatnear AS MATERIALIZED (SELECT n.r, n.c, n.nr, n.nc FROM near n JOIN labels a ON a.r = n.r AND a.c = n.c JOIN labels b ON b.r = n.nr AND b.c = n.nc AND a.label = b.label JOIN fdr g ON g.r = n.nr AND g.c = n.nc AND g.d = 8),
-- no shortest path within a flat is longer than the largest flat
sizes AS MATERIALIZED (SELECT coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM labels GROUP BY label)),
up(r, c, n) AS (SELECT r, c, 1 FROM kinds JOIN labels USING (r, c) WHERE kind = 'high' UNION SELECT f.nr, f.nc, n + 1 FROM up JOIN flatnear f ON f.r = up.r AND f.c = up.c WHERE n <= (SELECT most FROM sizes)),
down(r, c, n) AS (SELECT r, c, 1 FROM kinds WHERE kind = 'low' UNION SELECT f.nr, f.nc, n + 1 FROM down JOIN flatnear f ON f.r = down.r AND f.c = down.c WHERE n <= (SELECT most FROM sizes)),
away AS MATERIALIZED (SELECT r, c, min(n) AS n FROM up GROUP BY r, c),
low AS MATERIALIZED (SELECT r, c, min(n) AS n FROM down GROUP BY r, c),
found AS MATERIALIZED (SELECT r, c, label, away.n AS a, low.n AS l, max(coalesce(away.n, 0)) OVER (PARTITION BY label) AS h FROM labels LEFT JOIN away USING (r, c) LEFT JOIN low USING (r, c)),
masks AS MATERIALIZED (SELECT r, c, coalesce(label, 0) AS label, CASE WHEN l > 0 THEN 2 * l + CASE WHEN a > 0 THEN h - a ELSE 0 END ELSE -coalesce(a, 0) END AS mask FROM cells LEFT JOIN found USING (r, c))"""

_DRAINED = """drained AS MATERIALIZED (SELECT f.r, f.c, CASE WHEN f.d = 8 THEN coalesce(m.k, 8) ELSE f.d END AS d FROM fdr f LEFT JOIN (
  SELECT r, c, k FROM (SELECT a.r, a.c, n.k, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.mask - b.mask) / n.dist DESC, n.k) AS i
    FROM masks a JOIN near n ON n.r = a.r AND n.c = a.c JOIN masks b ON b.r = n.nr AND b.c = n.nc AND b.label = a.label WHERE a.label > 0 AND a.mask > b.mask) WHERE i = 1) m ON m.r = f.r AND m.c = f.c)"""


def _walk(table: str) -> str:
    return f"""flowing AS MATERIALIZED (SELECT f.r, f.c, g.r AS nr, g.c AS nc FROM {table} f JOIN steps ON k = f.d JOIN {table} g ON g.r = f.r + dr AND g.c = f.c + dc AND g.d <> 9),
walk(r, c, depth) AS (SELECT r, c, 0 FROM {table} WHERE d <> 9 UNION ALL SELECT f.nr, f.nc, depth + 1 FROM walk JOIN flowing f USING (r, c)),
fac AS (SELECT r, c, count(*) AS n FROM walk GROUP BY r, c)"""


# Single-cell pits in one order. Pits within three steps of one another stand in different lines of 4 r + c, the later
# ones in later lines; a row beside the cells' counts lines, others tell which pits are solved.
_SINGLE = """lower AS MATERIALIZED (SELECT r, c, any_value(z) AS z FROM near GROUP BY r, c HAVING count(*) FILTER (nz > z) = 8),
pits AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY 4 * r + c) AS line FROM lower),
run(r, c, z, line) USING KEY (r, c) AS (
  SELECT r, c, CAST(z AS FLOAT), 0::BIGINT FROM cells UNION ALL SELECT -9, -9, 0, 0
  UNION
  (WITH hits AS (
    SELECT p.r AS pr, p.c AS pc, p.r + near_r AS r, p.c + near_c AS c, k, CAST(CASE WHEN f.z IS NULL THEN (p.z - 9999) / 2.0 ELSE CAST(p.z + f.z AS FLOAT) / 2.0 END AS FLOAT) AS z, p.line
    FROM run t JOIN pits p ON t.r = -9 AND p.line = t.line + 1 CROSS JOIN ring LEFT JOIN recurring.run f ON f.r = p.r + far_r AND f.c = p.c + far_c WHERE f.z IS NULL OR f.z <= p.z)
  SELECT r, c, arg_max(z, k), any_value(line) FROM hits GROUP BY r, c
  UNION ALL SELECT DISTINCT -100 - pr, pc, 1.0, line FROM hits
  UNION ALL SELECT -9, -9, 0, line + 1 FROM run WHERE r = -9 AND line < (SELECT max(line) FROM pits))),
single AS MATERIALIZED (SELECT a.r, a.c, a.z, p.r IS NOT NULL AND s.r IS NULL AS pit FROM run a LEFT JOIN pits p ON p.r = a.r AND p.c = a.c LEFT JOIN run s ON s.r = -100 - a.r AND s.c = a.c WHERE a.r >= 0)"""

# All pits search at once, and take a cell each in a step: the cheapest that they have reached. Row -9 of a pit stands for
# one that goes on, row -8 for one that has an outlet, which is where it was reached from.
_SEARCH = f"""searched(pr, pc, r, c, cost, fr, fc, done) USING KEY (pr, pc, r, c) AS (
  SELECT r, c, r, c, 0::FLOAT, NULL::BIGINT, NULL::BIGINT, false FROM single WHERE pit UNION ALL SELECT r, c, -9, -9, 0, NULL, NULL, false FROM single WHERE pit
  UNION
  (WITH tops AS (SELECT s.pr, s.pc, arg_min({{'r': s.r, 'c': s.c, 'fr': s.fr, 'fc': s.fc}}, s.cost) AS t, min(s.cost) AS cost
    FROM searched k JOIN recurring.searched s ON s.pr = k.pr AND s.pc = k.pc WHERE k.r = -9 AND NOT s.done AND s.r > -8 GROUP BY s.pr, s.pc),
  here AS (SELECT tops.*, p.z AS low, h.z IS NULL OR h.z < p.z AS ends FROM tops JOIN single p ON p.r = pr AND p.c = pc LEFT JOIN single h ON h.r = t.r AND h.c = t.c),
  next AS (SELECT h.*, t.r + dr AS r, t.c + dc AS c, CASE WHEN z.z IS NULL THEN CAST(cost AS DOUBLE) ELSE CAST(cost AS DOUBLE) + CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0) ELSE 1.0 END * (CAST(z.z AS DOUBLE) - CAST(low AS DOUBLE)) END AS new
    FROM here h CROSS JOIN steps LEFT JOIN single z ON z.r = t.r + dr AND z.c = t.c + dc WHERE NOT ends AND abs(t.r + dr - pr) <= {NEAR} AND abs(t.c + dc - pc) <= {NEAR})
  SELECT pr, pc, t.r, t.c, cost, t.fr, t.fc, true FROM here
  UNION ALL SELECT pr, pc, CASE WHEN ends THEN -8 ELSE -9 END, CASE WHEN ends THEN -8 ELSE -9 END, cost, t.r, t.c, ends FROM here
  UNION ALL SELECT n.pr, n.pc, n.r, n.c, CAST(new AS FLOAT), n.t.r, n.t.c, false FROM next n LEFT JOIN recurring.searched e ON e.pr = n.pr AND e.pc = n.pc AND e.r = n.r AND e.c = n.c WHERE e.cost IS NULL OR new < CAST(e.cost AS DOUBLE))),
reached AS MATERIALIZED (SELECT * FROM searched),
paths(pr, pc, r, c, j) AS (
  SELECT pr, pc, fr, fc, 0 FROM reached WHERE r = -8
  UNION ALL SELECT p.pr, p.pc, s.fr, s.fc, j + 1 FROM paths p JOIN reached s ON s.pr = p.pr AND s.pc = p.pc AND s.r = p.r AND s.c = p.c WHERE s.fr IS NOT NULL),
falls AS (SELECT p.*, max(j) OVER (PARTITION BY p.pr, p.pc) AS n, CAST(o.z AS DOUBLE) AS low, CAST(e.z AS DOUBLE) AS out
  FROM paths p JOIN single o ON o.r = p.pr AND o.c = p.pc JOIN reached x ON x.pr = p.pr AND x.pc = p.pc AND x.r = -8 LEFT JOIN single e ON e.r = x.fr AND e.c = x.fc),
lowered AS (SELECT r, c, CAST(min(CASE WHEN out IS NULL THEN low - (n - j) * 1e-5 ELSE out + (low - out) * j / n END) AS FLOAT) AS new_z FROM falls WHERE j < n AND (j > 0 OR out IS NOT NULL) GROUP BY r, c)"""


def oracle_sql() -> dict[str, str]:
    rc = 'r AS "row", c AS col'
    fine, tilted = f"WITH RECURSIVE {_cells_sql()}", f"WITH RECURSIVE {_cells_sql(tilt=TILT)}, {_FDR}"
    flat = f"WITH RECURSIVE {_cells_sql(COARSE)}, {_FDR}, {_EDGES}, {_LABELS}, {_DISTANCES}, {_DRAINED}"
    border = "(r = 0 OR c = 0 OR r = (SELECT max(r) FROM cells) OR c = (SELECT max(c) FROM cells))"
    hidden = f"WITH {_cells_sql(hide=HIDDEN)}"
    tiles = f"tiles AS (SELECT y AS tile_row, x AS tile_col FROM (SELECT unnest(generate_series(0, max(r) // {CHUNK})) AS y FROM cells), (SELECT unnest(generate_series(0, max(c) // {CHUNK})) AS x FROM cells))"
    ring = "ring(k, far_r, far_c, near_r, near_c) AS (VALUES " + ", ".join(f"({k}, {a}, {b}, {c}, {d})" for k, ((a, b), (c, d)) in enumerate(pits.RING)) + ")"
    return {
        "dem_cells": f"{fine} SELECT {rc}, z FROM cells",
        "window_read_oob": f"{fine} SELECT y AS \"row\", x AS col, z FROM (SELECT unnest(generate_series(-5, 34)) AS y), (SELECT unnest(generate_series(50, 79)) AS x) LEFT JOIN cells ON r = y AND c = x",
        "chunk_index": f"{fine}, {tiles} SELECT tile_row, tile_col, tile_row * {CHUNK} AS y0, tile_col * {CHUNK} AS x0, least({CHUNK}, (SELECT max(r) + 1 FROM cells) - tile_row * {CHUNK}) AS h, least({CHUNK}, (SELECT max(c) + 1 FROM cells) - tile_col * {CHUNK}) AS w FROM tiles",
        "chunk_halo_counts": f"{fine}, {tiles} SELECT tile_row, tile_col, count(*) AS cells, CAST(sum(z) AS BIGINT) AS total FROM tiles JOIN cells ON r BETWEEN tile_row * {CHUNK} - 2 AND tile_row * {CHUNK} + {CHUNK} + 1 AND c BETWEEN tile_col * {CHUNK} - 2 AND tile_col * {CHUNK} + {CHUNK} + 1 GROUP BY ALL",
        "chunk_core_roundtrip": f"{fine} SELECT {rc}, z FROM cells",
        "neighbor_slopes": f"{fine} SELECT {rc}, k AS code, CAST(z - nz AS DOUBLE) / dist AS slope FROM near WHERE z IS NOT NULL",
        "flow_direction": f"{fine}, {_FDR} SELECT {rc}, CAST(d AS SMALLINT) AS fdr FROM fdr",
        "flow_direction_nodata": f"{hidden}, {_FDR} SELECT {rc}, CAST(d AS SMALLINT) AS fdr FROM fdr",
        "downstream_edges": f"{tilted} SELECT {rc}, nr AS to_row, nc AS to_col FROM flow WHERE nd IS NOT NULL",
        "inflow_count": f"{tilted} SELECT {rc}, CASE WHEN d <> 9 THEN coalesce(n, 0) END AS inflow FROM fdr LEFT JOIN (SELECT nr AS r, nc AS c, count(*) AS n FROM flow WHERE nr IS NOT NULL GROUP BY ALL) USING (r, c)",
        "tile_perimeter": f"{fine} SELECT {rc} FROM cells WHERE {border}",
        "flow_accumulation": f"{tilted}, {_walk('fdr')} SELECT {rc}, coalesce(n, -9999) AS fac FROM fdr LEFT JOIN fac USING (r, c)",
        "flow_links": f"""{tilted}, paths(sr, sc, r, c) AS (SELECT r, c, r, c FROM fdr WHERE {border} UNION ALL SELECT sr, sc, f.nr, f.nc FROM paths p JOIN flow f ON f.r = p.r AND f.c = p.c AND f.nd < 8),
ends AS (SELECT sr, sc, f.r, f.c, f.d < 8 AND f.nd IS NULL AS leaves FROM paths p JOIN flow f USING (r, c) WHERE coalesce(f.nd, 9) >= 8)
SELECT sr AS "row", sc AS col, CASE WHEN leaves AND sr = r AND sc = c THEN -2 WHEN leaves THEN r ELSE -1 END AS link_row, CASE WHEN leaves AND sr = r AND sc = c THEN -2 WHEN leaves THEN c ELSE -1 END AS link_col FROM ends""",
        "tile_accumulation": f"""{tilted}, inside AS MATERIALIZED (SELECT r, c, nr, nc FROM flow WHERE nd < 9 AND nr // {CHUNK} = r // {CHUNK} AND nc // {CHUNK} = c // {CHUNK}),
walk(r, c) AS (SELECT r, c FROM fdr WHERE d <> 9 UNION ALL SELECT f.nr, f.nc FROM walk JOIN inside f USING (r, c))
SELECT {rc}, coalesce(n, -9999) AS fac FROM fdr LEFT JOIN (SELECT r, c, count(*) AS n FROM walk GROUP BY r, c) USING (r, c)""",
        "tile_links": f"""{tilted}, own AS MATERIALIZED (SELECT r, c, d, nr, nc, CASE WHEN nr // {CHUNK} = r // {CHUNK} AND nc // {CHUNK} = c // {CHUNK} THEN nd END AS nd FROM flow),
paths(sr, sc, r, c) AS (SELECT r, c, r, c FROM fdr WHERE r % {CHUNK} IN (0, {CHUNK - 1}) OR c % {CHUNK} IN (0, {CHUNK - 1}) OR {border} UNION ALL SELECT sr, sc, f.nr, f.nc FROM paths p JOIN own f ON f.r = p.r AND f.c = p.c AND f.nd < 8),
ends AS (SELECT sr, sc, f.r, f.c, f.d < 8 AND f.nd IS NULL AS leaves FROM paths p JOIN own f USING (r, c) WHERE coalesce(f.nd, 9) >= 8)
SELECT sr AS "row", sc AS col, CASE WHEN leaves AND sr = r AND sc = c THEN -2 WHEN leaves THEN r ELSE -1 END AS link_row, CASE WHEN leaves AND sr = r AND sc = c THEN -2 WHEN leaves THEN c ELSE -1 END AS link_col FROM ends""",
        "flow_cycles": f"""{flat}, loose AS MATERIALIZED (SELECT f.r, f.c, CASE WHEN f.d = 8 THEN coalesce(m.k, 8) ELSE f.d END AS d FROM fdr f LEFT JOIN (
  SELECT r, c, k FROM (SELECT a.r, a.c, n.k, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.mask - b.mask) / n.dist DESC, n.k) AS i
    FROM masks a JOIN near n ON n.r = a.r AND n.c = a.c JOIN masks b ON b.r = n.nr AND b.c = n.nc AND b.label = a.label) WHERE i = 1) m ON m.r = f.r AND m.c = f.c),
onward AS MATERIALIZED (SELECT f.r, f.c, g.r AS nr, g.c AS nc FROM loose f JOIN steps ON k = f.d JOIN loose g ON g.r = f.r + dr AND g.c = f.c + dc AND g.d <> 9),
ahead(sr, sc, r, c) AS (SELECT r, c, nr, nc FROM onward UNION SELECT sr, sc, o.nr, o.nc FROM ahead a JOIN onward o USING (r, c)),
looping AS MATERIALIZED (SELECT sr, sc FROM ahead WHERE sr = r AND sc = c),
named AS (SELECT a.sr, a.sc, min({{'r': a.r, 'c': a.c}}) AS least, count(*) AS n FROM ahead a JOIN looping USING (sr, sc) GROUP BY ALL)
SELECT sr AS "row", sc AS col, least.r AS cycle_row, least.c AS cycle_col, n AS length FROM named""",
        "flat_edges": f"{flat} SELECT {rc}, kind FROM kinds WHERE kind IS NOT NULL",
        "flat_labels": f"{flat} SELECT {rc}, CAST(label AS INTEGER) AS label FROM labels",
        "flat_away": f"{flat} SELECT {rc}, n AS away FROM away",
        "flat_lower": f"{flat} SELECT {rc}, n AS low FROM low",
        "flat_mask": f"{flat} SELECT {rc}, CAST(label AS INTEGER) AS label, CAST(mask AS INTEGER) AS flat_mask FROM masks",
        "flat_flow_direction": f"{flat} SELECT {rc}, CAST(d AS SMALLINT) AS fdr FROM drained",
        "single_cell_pits": f"{fine} SELECT {rc}, any_value(z) AS z FROM near GROUP BY r, c HAVING count(*) FILTER (nz > z) = 8",
        "breach_single_cell_pits": f"""WITH {_cells_sql().replace("cells AS MATERIALIZED", "raw AS").split("steps(k")[0]} {ring},
cells AS MATERIALIZED (SELECT r, c, CAST(10 * r + c - CASE WHEN r % 8 = 4 AND c % 8 = 4 THEN 12 + ((z % 28) + 28) % 28 ELSE 0 END AS DOUBLE) AS z FROM raw),
lower AS (SELECT a.r, a.c, a.z FROM cells a JOIN cells b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE a.r % 8 = 4 AND a.c % 8 = 4 GROUP BY ALL HAVING count(*) FILTER (b.z > a.z) = 8),
hits AS (SELECT p.r AS pr, p.c AS pc, p.r + near_r AS r, p.c + near_c AS c, k, (p.z + f.z) / 2 AS z FROM lower p CROSS JOIN ring JOIN cells f ON f.r = p.r + far_r AND f.c = p.c + far_c WHERE f.z <= p.z),
changed AS (SELECT r, c, arg_max(z, k) AS z FROM hits GROUP BY r, c)
SELECT {rc}, coalesce(changed.z, cells.z) AS z, EXISTS (SELECT 1 FROM lower p WHERE p.r = cells.r AND p.c = cells.c) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.pr = cells.r AND h.pc = cells.c) AS pit FROM cells LEFT JOIN changed USING (r, c)""",
        "breach_dense_pits": f"""{fine}, {ring}, {_SINGLE}
SELECT {rc}, CAST(z AS DOUBLE) AS z, pit FROM single""",
        "least_cost_paths": f"""WITH RECURSIVE {_cells_sql(FINEST)}, {ring}, {_SINGLE}, {_SEARCH}
SELECT r AS "row", c AS col, CAST(least(z, coalesce(new_z, z)) AS DOUBLE) AS z FROM single LEFT JOIN lowered USING (r, c)""",
        "drainage_pipeline": f"WITH RECURSIVE {_cells_sql(COARSE, tilt=1)}, {_FDR}, {_EDGES}, {_LABELS}, {_DISTANCES}, {_DRAINED}, {_walk('drained')} SELECT {rc}, CAST(d AS SMALLINT) AS fdr, coalesce(n, -9999) AS fac FROM drained LEFT JOIN fac USING (r, c)",
        "drainage_tiles": f"WITH RECURSIVE {_cells_sql(COARSE, tilt=1, hide=HIDDEN)}, {_FDR}, {_EDGES}, {_LABELS}, {_DISTANCES}, {_DRAINED}, {_walk('drained')} SELECT {rc}, CAST(d AS SMALLINT) AS fdr, CAST(label AS INTEGER) AS label, CAST(mask AS INTEGER) AS flat_mask, coalesce(n, -9999) AS fac FROM drained LEFT JOIN fac USING (r, c) JOIN masks USING (r, c)",
        "parquet_roundtrip": f"{hidden} SELECT {rc}, z FROM cells",
        "ascii_roundtrip": f"{hidden} SELECT {rc}, z FROM cells",
        "tiff_roundtrip": f"{hidden} SELECT {rc}, z FROM cells",
        "tiff_window": f"{hidden} SELECT y AS \"row\", x AS col, z FROM (SELECT unnest(generate_series(-5, 34)) AS y), (SELECT unnest(generate_series(50, 79)) AS x) LEFT JOIN cells ON r = y AND c = x",
    }
