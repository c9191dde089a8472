"""Patches of a raster: 4-connected components of its hit cells.

Cells are labelled within square tiles of at most ``tile`` x ``tile`` cells, many small ones at a time; labels
that meet across tile edges are linked, and the links' components join the tiles, so a patch is never cut by a
tile and a scene of any size is spread over its tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.operators.graph import components
from landshift.sources.shared import written

TILE = 512
_SIDE = 1 << 20
#: Scenes from the first number on have ids below zero and cells below the second.
_FAR, _FAR_SIDE = 1 << 23, 1 << 16


def cell_id(scene: Column, row: Column, col: Column) -> Column:
    """A scene number and a cell in one long, in row order within the scene: scenes below 2**23 with cells below
    2**20 x 2**20, and scenes from there to 2**31 with cells below 2**16 x 2**16, whose ids are less than zero. What
    fits neither is an error."""
    scene, row, col = scene.cast("long"), row.cast("long"), col.cast("long")
    near = scene * (_SIDE * _SIDE) + row * _SIDE + col
    far = (scene - _FAR) * (_FAR_SIDE * _FAR_SIDE) + row * _FAR_SIDE + col + F.lit(-(1 << 63))
    fits = (row < _FAR_SIDE - 1) & (col < _FAR_SIDE - 1)  # the last ones have no id beside them
    return F.when(scene < _FAR, near).when(fits, far).otherwise(F.raise_error(F.lit("a raster of more than 65,535 cells a side in a scene beyond 2**23")))


def _row_of(cell: Column) -> Column:
    return F.when(cell < 0, F.shiftright(cell, 16).bitwiseAND(_FAR_SIDE - 1)).otherwise(F.shiftright(cell, 20).bitwiseAND(_SIDE - 1))


def _col_of(cell: Column) -> Column:
    return F.when(cell < 0, cell.bitwiseAND(_FAR_SIDE - 1)).otherwise(cell.bitwiseAND(_SIDE - 1))


def over_tiles(cells: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 1 << 16) -> DataFrame:
    """``work`` on whole tiles (scene, t_row, t_col) of ``cells``, about ``most`` rows of them at a time: a call for
    each tile would cost more than its cells where scenes are small."""
    keys = ["scene", "t_row", "t_col"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, first = 0, 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size < max(most, first):
                continue
            rows = pd.concat(held, ignore_index=True)
            same = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(same))
            if cut:
                yield work(rows[:cut])
            held, size = [rows[cut:]], len(rows) - cut
            first = 2 * size  # a tile that is still coming is not looked through again for each frame
        if size:
            yield work(pd.concat(held, ignore_index=True))

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _tile_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    """The least cell of each component: runs of cells in a row, linked to the runs they meet in the row below; the
    larger of two linked roots is hooked to the smaller until no link is left between two."""
    cells = np.sort(pdf["cell"].to_numpy())
    run = np.cumsum(np.append(True, cells[1:] != cells[:-1] + 1)[: len(cells)]) - 1
    down = cells + np.where(cells < 0, _FAR_SIDE, _SIDE)
    below = np.minimum(np.searchsorted(cells, down), len(cells) - 1)
    met = np.flatnonzero(cells[below] == down)
    u, v = run[met], run[below[met]]
    root = np.arange(run[-1] + 1 if len(run) else 0)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(shorter := root[root], root):
            root = shorter
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])
    return pd.DataFrame({"cell": cells, "label": cells[first[root[run]]]})


def patches(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """``cells`` (scene, row, col, …) with ``patch``, the least cell id of its component."""
    marked = cells.withColumn("cell", cell_id(F.col("scene"), F.col("row"), F.col("col")))
    tiles = marked.select("cell", "scene", F.floor(F.col("row") / tile).alias("t_row"), F.floor(F.col("col") / tile).alias("t_col"))
    local = over_tiles(tiles, _tile_labels, "cell long, label long")
    local = written(local, "tile-labels")
    cell = F.col("cell")
    at_edge = local.where((_col_of(cell) % tile == tile - 1) | (_row_of(cell) % tile == tile - 1))
    near = at_edge.select("label", F.explode(F.array(cell + 1, cell + F.when(cell < 0, _FAR_SIDE).otherwise(_SIDE))).alias("cell"))
    links = near.withColumnRenamed("label", "u").join(local, "cell").select("u", F.col("label").alias("v")).where("u != v")
    joined = components(links)
    label = local.join(joined, local.label == joined.node, "left").select("cell", F.coalesce("component", "label").alias("patch"))
    return marked.join(label, "cell")


def patch_table(cells: DataFrame, value: str, cell_area_m2: float, min_area_m2: float = 0.0, tile: int = TILE) -> DataFrame:
    """One row per patch of at least the least area: scene, patch, cells, area, mean and least value, bounds."""
    return patch_stats(patches(cells, tile), value, cell_area_m2, min_area_m2)


def patch_stats(labelled: DataFrame, value: str, cell_area_m2: float, min_area_m2: float = 0.0) -> DataFrame:
    """``patch_table`` of cells that have their patch."""
    out = labelled.groupBy("scene", "patch").agg(
        F.count("*").alias("cells"), (F.count("*") * F.lit(cell_area_m2)).alias("area_m2"), F.avg(value).alias("delta_mean"), F.min(value).alias("delta_min"),
        F.min("row").alias("row_from"), F.max("row").alias("row_to"), F.min("col").alias("col_from"), F.max("col").alias("col_to"),
    )
    return out.where(F.col("area_m2") >= min_area_m2)
