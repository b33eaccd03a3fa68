"""Cells of the arithmetic grid, and region selection.

A cell is a long: row * 2**32 + column, of a grid whose cells are about CELL_M wide everywhere. Ids stored in tile files are H3 ids; they
are compared after normalize_cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.functions import geo

from . import knn

CELL_M = 1200.0
#: Most cells of a box.
BOUNDS_CELLS = 512
#: Fixed value: the filler bits of a resolution-7 cell id.
FILLER = 0x1FFFFF
VIEWPORT_CELLS = 300


def normalize_cell(cell: Column) -> Column:
    """A cell id without its filler bits, for comparisons."""
    return cell.bitwiseAND(F.lit(~FILLER))


def state_of(queries: DataFrame, states: DataFrame) -> DataFrame:
    """The state (fid, lat0, lon0, lat1, lon1) whose box holds the point, the one with the nearest centre among several; if none holds
    it, the nearest centre: qid, fid, inside. Centres may be given (mid_lat, mid_lon), for those whose last bit counts. The states are a table
    of a few dozen rows, which Spark broadcasts by its own check."""
    q = queries.select("qid", "lat", "lon")
    if "mid_lat" not in states.columns:
        states = states.withColumns({"mid_lat": (F.col("lat0") + F.col("lat1")) / 2, "mid_lon": (F.col("lon0") + F.col("lon1")) / 2})
    pairs = q.join(states, F.lit(True))
    hit = F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lon").between(F.col("lon0"), F.col("lon1"))
    dy, dx = F.col("lat") - F.col("mid_lat"), F.col("lon") - F.col("mid_lon")
    d = dy * dy + dx * dx
    return pairs.groupBy("qid").agg(F.min_by("fid", F.struct(~hit, d, "fid")).alias("fid"), F.bool_or(hit).alias("inside"))


def viewport(cells: DataFrame, most: int = VIEWPORT_CELLS) -> DataFrame:
    """The cells of a viewport nearest its centre first, at most `most` (cells with distance_m)."""
    return cells.orderBy("distance_m", "cell").limit(most)


def cell_of(lat: Column, lon: Column, cell_m: float = CELL_M) -> Column:
    """The cell of a coordinate; 0 for one that isn't on the globe."""
    ok = geo.is_finite(lat) & geo.is_finite(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, knn.cell(lat, lon, cell_m)).otherwise(F.lit(0).cast("long"))


def cell_center(cell: Column, cell_m: float = CELL_M) -> Column:
    """STRUCT<lat, lon> of a cell's centre."""
    h = knn._height(cell_m)
    row, column = F.shiftright(cell, 32), cell.bitwiseAND(F.lit((1 << 32) - 1))
    n = knn._columns(row, cell_m)
    return F.struct(((row + 0.5) * h - 90).alias("lat"), ((column + 0.5) * 360 / n - 180).alias("lon"))


def neighbor_cells(cell: Column, cell_m: float = CELL_M) -> Column:
    """The cells that touch a cell: those around its centre, without itself."""
    c = cell_center(cell, cell_m)
    return F.array_remove(knn.cells_around(c.lat, c.lon, cell_m), cell)


def candidate_cells(lat: Column, lon: Column, ring: int = 0, cell_m: float = CELL_M) -> Column:
    """The cell of a query, with its neighbours if ring is 1."""
    if ring not in (0, 1):
        raise ValueError("ring must be 0 or 1")
    own = cell_of(lat, lon, cell_m)
    return F.array(own) if ring == 0 else F.array_union(F.array(own), neighbor_cells(own, cell_m))


def cells_of_bounds(lat0, lon0, lat1, lon1, cell_m: float = CELL_M) -> Column:
    """C4 of columns: the cells of a box, an array; NULL for a box that is inverted or not finite, or of over BOUNDS_CELLS cells."""
    lat0, lon0, lat1, lon1 = map(geo._c, (lat0, lon0, lat1, lon1))
    h = knn._height(cell_m)
    ok = geo.is_finite(lat0) & geo.is_finite(lon1) & (lat0 >= -90) & (lat0 <= lat1) & (lat1 <= 90) & (lon0 >= -180) & (lon0 <= lon1) & (lon1 <= 180)
    ok = ok & (((lat1 - lat0) / h + 1) * ((lon1 - lon0) / h + 1) <= 4 * BOUNDS_CELLS)

    def of(row):
        n = knn._columns(row, cell_m)
        return F.transform(F.sequence(knn._column(lon0, n), knn._column(F.least(lon1, F.lit(179.9999999)), n)), lambda c: knn._key(row, c, n))

    found = F.flatten(F.transform(F.sequence(knn.grid_row(lat0, cell_m), knn.grid_row(lat1, cell_m)), of))
    return F.when(ok, geo.let(found, lambda x: F.when(F.size(x) <= BOUNDS_CELLS, x)))


def cells_for_bounds(spark, lat0: float, lon0: float, lat1: float, lon1: float, cell_m: float = CELL_M) -> list[int]:
    """C4: the cells of a box. ValueError for a box that is inverted, not finite or of over BOUNDS_CELLS cells."""
    if not (-90 <= lat0 <= lat1 <= 90 and -180 <= lon0 <= lon1 <= 180):
        raise ValueError("invalid bounds")
    h = knn._height(cell_m)
    if ((lat1 - lat0) / h + 1) * ((lon1 - lon0) / h + 1) > 4 * BOUNDS_CELLS:
        raise ValueError(f"too many cells: the most is {BOUNDS_CELLS}")
    row = F.explode(F.sequence(knn.grid_row(F.lit(lat0), cell_m), knn.grid_row(F.lit(lat1), cell_m))).alias("row")
    rows = spark.range(1).select(row).withColumn("n", knn._columns(F.col("row"), cell_m))
    span = F.explode(F.sequence(knn._column(F.lit(lon0), F.col("n")), knn._column(F.lit(min(lon1, 179.9999999)), F.col("n")))).alias("column")
    cells = [r.c for r in rows.select("row", "n", span).select(knn._key(F.col("row"), F.col("column"), F.col("n")).alias("c")).collect()]
    if len(cells) > BOUNDS_CELLS:
        raise ValueError(f"too many cells: the most is {BOUNDS_CELLS}")
    return cells
