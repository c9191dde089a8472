"""Footprints of raster cells as runs: (…, row, c0, c1), the cells of a row from column c0 up to but without c1.

Cells are closed squares: two footprints intersect where they share so much as an edge or a corner, so two L shapes that
lie in each other's box may well be apart. Two ways to find that:

* ``touching`` joins runs as intervals. A run meets the runs of its own row and of the rows above and below; rows are
  cut into stretches of columns, so the join is by row and stretch, and a pair of runs is kept only in the
  stretch where what they share begins.
* ``linked_before`` needs no pairs of footprints. Closed cells intersect exactly if they share a corner point of the
  grid, so footprints are laid out by grid points, and at each point every one is linked to the one before it in
  order. Along such links each reaches all that come before it at that point: what can be reached is the same as with
  all pairs, but a place that is seen again and again has as many links as looks, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landshift.functions.geometry import cell_area_m2
from landshift.operators.boxes import listed, near_pairs, spelled
from landshift.sources.shared import written

STRETCH, TILE, SPREAD = 64, 16, 4


def runs(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys…, row, c0, c1) of (keys…, row, col); cells may be repeated."""
    line = Window.partitionBy(*keys, "row").orderBy("col")
    # Within a run the column and its rank among the distinct columns go up together.
    placed = cells.select(*keys, "row", F.col("col").cast("long").alias("col"), (F.col("col") - F.dense_rank().over(line)).alias("start"))
    return placed.groupBy(*keys, "row", "start").agg(F.min("col").alias("c0"), (F.max("col") + 1).alias("c1")).drop("start")


def cells(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys…, row, col) of runs."""
    return rows.select(*keys, "row", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("col"))


def box_runs(boxes: DataFrame, *keys: str) -> DataFrame:
    """(keys…, row, c0, c1): boxes (x0, y0, x1, y1) of cells as a run for each of their rows; boxes without area have none."""
    wide = boxes.where("x0 < x1 AND y0 < y1")
    return wide.select(*keys, F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("row"), F.col("x0").alias("c0"), F.col("x1").alias("c1"))


def bounds(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys…, x0, y0, x1, y1) of footprints."""
    return rows.groupBy(*keys).agg(F.min("c0").alias("x0"), F.min("row").alias("y0"), F.max("c1").alias("x1"), (F.max("row") + 1).alias("y1"))


def united(rows: DataFrame, *keys: str) -> DataFrame:
    """The union of the footprints that share keys, as runs. Runs are merged as intervals, cells are never made rows."""
    line = Window.partitionBy(*keys, "row").orderBy("c0", "c1")
    reach = F.max("c1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.select(*keys, "row", "c0", "c1", F.when(F.col("c0") <= reach, 0).otherwise(1).alias("new"))
    numbered = opened.withColumn("number", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "row", "number").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("number")


def _stretches(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / STRETCH), F.floor(high / STRETCH)))


def touching(left: DataFrame, right: DataFrame, equal: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """Distinct (l_id, r_id) of footprints (id, row, c0, c1, …) that intersect and agree in ``equal``; ``where`` is a
    further condition on columns l_* and r_*."""
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("at_row", F.explode(F.array(F.col("l_row") - 1, F.col("l_row"), F.col("l_row") + 1)))
    a = a.withColumn("stretch", _stretches(F.col("l_c0"), F.col("l_c1")))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("r_stretch", _stretches(F.col("r_c0"), F.col("r_c1")))
    on = (a.at_row == b.r_row) & (a.stretch == b.r_stretch)
    for k in equal:
        on = on & (a[f"l_{k}"] == b[f"r_{k}"])
    met = (F.col("l_c0") <= F.col("r_c1")) & (F.col("r_c0") <= F.col("l_c1")) & (F.floor(F.greatest("l_c0", "r_c0") / STRETCH) == F.col("stretch"))
    pairs = a.join(b, on).where(met if where is None else met & where)
    return pairs.select("l_id", "r_id").distinct()


def outlines(rows: DataFrame, *keys: str) -> DataFrame:
    """(id, keys…, runs): a row for each footprint (id, keys…, row, c0, c1), its runs in order."""
    return rows.groupBy("id", *keys).agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("row", "c0", "c1")))).alias("runs"))


def touching_lists(rows: DataFrame, equal: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (l_id, r_id), both orders and each with itself, of footprints (id, row, c0, c1, equal…) that intersect.

    Equal footprints are compared once, by their runs within what their boxes share; a pair of boxes is met in one
    bucket only, so pairs have to be neither made distinct nor shuffled."""
    edge = lambda f, c: f(F.transform("runs", lambda r: r[c]))
    shapes = listed(outlines(rows, *equal), *equal, "runs").withColumns({"x0": edge(F.array_min, "c0"), "y0": edge(F.array_min, "row"), "x1": edge(F.array_max, "c1"), "y1": edge(F.array_max, "row") + 1})
    met = near_pairs(shapes, shapes, equal)
    low, high = F.greatest("l_y0", "r_y0") - 1, F.least("l_y1", "r_y1")
    shared = lambda side: F.filter(f"{side}_runs", lambda r: r["row"].between(low, high))
    touch = lambda a, b: (a["row"] - b["row"]).between(-1, 1) & (a["c0"] <= b["c1"]) & (b["c0"] <= a["c1"])
    met = met.where(F.exists(shared("l"), lambda a: F.exists(shared("r"), lambda b: touch(a, b))))
    return spelled(met.select("l_ids", "r_ids"))


def shapes(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Equal footprints (id, keys…, row, c0, c1) told once: (id, keys…, row, c0, c1) of the least id of each kind, and
    (id, of), the id that stands for each."""
    alike = Window.partitionBy(*keys, "runs")
    found = outlines(rows, *keys).withColumn("of", F.min("id").over(alike))
    found = written(found.select("id", *keys, "of", F.when(F.col("id") == F.col("of"), F.col("runs")).alias("runs")), "shapes")
    spread = found.where("runs IS NOT NULL").select("id", *keys, F.explode("runs").alias("r")).select("id", *keys, "r.row", "r.c0", "r.c1")
    return spread, found.select("id", "of")


def points(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys…, p_row, p_col): the grid points of closed footprints; a point may come more than once."""
    across = rows.select(*keys, "row", F.explode(F.sequence(F.col("c0"), F.col("c1"))).alias("p_col"))
    return across.select(*keys, "p_col", F.explode(F.array(F.col("row"), F.col("row") + 1)).alias("p_row"))


def corner_points(boxes: DataFrame, keys: tuple[str, ...], equal: tuple[str, ...] = ()) -> DataFrame:
    """(keys…, p_row, p_col): points of closed boxes (x0, y0, x1, y1) of whole numbers whose column is where some box
    of its group ``equal`` begins and whose row is too. Where two boxes meet, what they share begins at such a point."""
    columns = boxes.select(*equal, F.col("x0").alias("p_col")).distinct()
    rows = boxes.select(*equal, F.col("y0").alias("p_row")).distinct()
    across = boxes.select(*keys, "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("p_col")).join(columns, [*equal, "p_col"])
    return across.select(*keys, "p_col", F.explode(F.sequence("y0", "y1")).alias("p_row")).join(rows, [*equal, "p_row"])


def linked_before(rows: DataFrame, order: tuple[str, ...], equal: tuple[str, ...] = ()) -> DataFrame:
    """``linked_at`` of the grid points of footprints (id, row, c0, c1, order…, equal…). Runs go through the shuffle, cut
    at tiles of ``TILE`` x ``TILE`` points; they become points where their tile is."""
    keys, tile = tuple(dict.fromkeys(("id", *order, *equal))), F.col("t_col") * TILE
    lines = rows.select(*keys, "c0", "c1", F.explode(F.array(F.col("row"), F.col("row") + 1)).alias("p_row"))
    laid = lines.select("*", F.floor(F.col("p_row") / TILE).alias("t_row"), F.explode(F.sequence(F.floor(F.col("c0") / TILE), F.floor(F.col("c1") / TILE))).alias("t_col"))
    # Points are many more than runs, so tasks are more than the size of the runs would make them.
    laid = laid.repartition(SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *equal, "t_row", "t_col")
    placed = laid.select(*keys, "t_row", "t_col", "p_row", F.explode(F.sequence(F.greatest("c0", tile), F.least("c1", tile + TILE - 1))).alias("p_col"))
    return linked_at(placed, order, (*equal, "t_row", "t_col"))


def linked_at(placed: DataFrame, order: tuple[str, ...], equal: tuple[str, ...] = ()) -> DataFrame:
    """(u, v, first): links of each footprint to the next one before it at some point (id, order…, equal…, p_row, p_col), and
    the first in order at the points of the link, which u leads to as well."""
    line = Window.partitionBy(*equal, "p_row", "p_col").orderBy(*order)
    # A footprint that has a point more than once follows itself there; the first of these still has its link.
    linked = placed.select(F.col("id").alias("u"), F.lag("id").over(line).alias("v"), F.first(F.struct(*order)).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    return linked.where("u != v").groupBy("u", "v").agg(F.min("first").alias("first"))


def grid_area_m2(row: Column, north: float, step: float, across: Column) -> Column:
    """Area on the ellipsoid of ``across`` cells of a row, on a grid of ``step`` degrees whose row 0 begins at latitude
    ``north`` and whose rows go south."""
    return cell_area_m2(F.lit(north) - (row + 1) * step, F.lit(north) - row * step, across * F.lit(step))
