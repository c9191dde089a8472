"""Patches of cells as polygons: closed rings with holes along the outer edges of their cells.

Each side of a cell that no cell of its patch lies behind is an edge, walked with the patch on its right (rows
go down, so outer rings run clockwise and holes the other way). At the end of an edge the next one follows from the two
cells ahead: neither turn is possible into a cell that is not there, and where two cells of a patch meet only at
that corner the walk stays with its own cell, so rings touch there but never cross, as patches are 4-connected.

1. Cells are dealt into tiles, with those around a tile as its border. Within a tile edges are linked and ranked by
   pointer doubling on arrays: a ring that lies in the tile is closed there, the others leave it as chains.
2. Chains are linked head to tail over tile borders and ranked by pointer doubling in Spark, first for the
   least chain of each ring, which is where it begins, then for the way to its end: rounds in the logarithm of the
   number of tiles that a ring runs through. No patch or ring is gathered for that.
3. Only corners become rows; a ring as a list of points is one row of a polygon, which is what a geometry is.

The sum of the rings' signed areas is the number of cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.operators.components import _SIDE, cell_id, over_tiles
from landshift.sources.shared import removed, written

TILE = 512

_CHAIN = "kind string, patch long, edge long, place long, chain long, head long, follows long, size long, row long, col long"


def _ranked(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last, steps, closed) of each node of a list whose nodes lead to others, -1 at the end: the end it leads to and the
    steps there. In a circle the end is the node before its least one."""
    n = len(follow)
    rounds = range(max(1, int(n).bit_length()))
    to = np.where(follow < 0, np.arange(n), follow)
    least = np.arange(n)
    for _ in rounds:
        least = np.minimum(least, least[to])
        to = to[to]
    closed = follow[to] >= 0
    end = (follow < 0) | (closed & (follow == least))
    to, steps = np.where(end, np.arange(n), follow), np.where(end, 0, 1)
    for _ in rounds:
        steps = steps + steps[to]
        to = to[to]
    return to, steps, closed


def _traced(tile: int):
    """The edges of whole tiles. A cell has a number of its own in each tile that it is dealt to, tile by tile in rows of
    ``wide`` cells, so no walk goes from one tile into the next."""
    wide = tile + 2
    # For edges above, right, below and left of a cell, walked clockwise: the cell straight ahead, the one across the corner, the one behind the edge.
    ahead_of, across_of, behind_of = np.array([1, wide, -1, -wide]), np.array([1 - wide, wide + 1, wide - 1, -wide - 1]), np.array([-wide, 1, wide, -1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scene, t_row, t_col, given = (pdf[c].to_numpy().astype(np.int64) for c in ("scene", "t_row", "t_col", "cell"))
        new = np.append(True, (scene[1:] != scene[:-1]) | (t_row[1:] != t_row[:-1]) | (t_col[1:] != t_col[:-1]))[: len(given)]
        number = np.cumsum(new) - 1
        top, left = (t_row * tile - 1), (t_col * tile - 1)
        base, top_of, left_of = (given // (_SIDE * _SIDE))[new], top[new], left[new]
        local = (number * wide + (given // _SIDE % _SIDE - top)) * wide + (given % _SIDE - left)
        order = np.argsort(local)
        cells, patch, own = local[order], pdf["patch"].to_numpy()[order], pdf["own"].to_numpy()[order]

        def world(at: np.ndarray) -> np.ndarray:
            """Edges by the cells that they have everywhere."""
            cell, of = at // 4, at // 4 // (wide * wide)
            return ((base[of] * _SIDE + cell // wide % wide + top_of[of]) * _SIDE + cell % wide + left_of[of]) * 4 + at % 4

        def at(wanted: np.ndarray, of: np.ndarray) -> np.ndarray:
            """Whether a cell is there and belongs to the patch."""
            k = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
            return (cells[k] == wanted) & (patch[k] == of)

        mine = np.flatnonzero(own)
        cell, side = np.repeat(cells[mine], 4), np.tile(np.arange(4), len(mine))
        of = np.repeat(patch[mine], 4)
        outer = ~at(cell + behind_of[side], of)
        cell, side, of = cell[outer], side[outer], of[outer]
        edge = cell * 4 + side
        ahead, across = at(cell + ahead_of[side], of), at(cell + across_of[side], of)
        turn = np.where(~ahead, 1, np.where(across, 3, 0))
        following = np.where(turn == 1, cell, np.where(turn == 3, cell + across_of[side], cell + ahead_of[side])) * 4 + (side + turn) % 4
        k = np.minimum(np.searchsorted(edge, following), max(len(edge) - 1, 0))
        follow = np.where(edge[k] == following, k, -1) if len(edge) else np.zeros(0, np.int64)
        last, steps, closed = _ranked(follow)
        # How far each edge is from where its chain begins.
        size = np.zeros(len(edge), np.int64)
        np.maximum.at(size, last, steps + 1)
        place = size[last] - 1 - steps
        # The corner at the end of an edge.
        edge, following = world(edge), world(following)
        row, col = edge // 4 // _SIDE % _SIDE, edge // 4 % _SIDE
        corner = turn != 0
        points = pd.DataFrame({"kind": np.where(closed, "ring", "chain"), "patch": of, "edge": edge, "place": place, "chain": edge[last], "head": -1, "follows": -1, "size": 0, "row": row + np.isin(side, (1, 2)), "col": col + np.isin(side, (0, 1))})[corner]
        first = np.flatnonzero(place == 0)
        first = first[~closed[first]]
        ends = last[first]
        links = pd.DataFrame({"kind": "link", "patch": of[first], "edge": -1, "place": -1, "chain": edge[ends], "head": edge[first], "follows": following[ends], "size": size[ends], "row": -1, "col": -1})
        return pd.concat([points, links], ignore_index=True)

    return run


def _doubled(state: DataFrame, name: str) -> DataFrame:
    """One round: each chain looks at what the chain it points to has seen and points to where that one points."""
    other = state.select(F.col("chain").alias("at"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("far").alias("far2"))
    both = state.join(other, F.col("to") == F.col("at"), "left")
    return written(both.select("chain", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("far") + F.coalesce("far2", F.lit(0).cast("long"))).alias("far")), name)


def _placed(links: DataFrame) -> DataFrame:
    """(chain, ring, before): the ring each chain belongs to, named by its least chain, and the edges before it."""
    heads = links.select(F.col("head").alias("h"), F.col("chain").alias("to"))
    onward = written(links.join(heads, F.col("follows") == F.col("h")).select("chain", "to", "size"), "ring-links")
    zero = F.lit(0).cast("long")
    state, seen = written(onward.select("chain", "to", F.col("chain").alias("least"), zero.alias("far")), "ring-least"), None
    while (now := state.agg(F.count("*"), F.sum(F.xxhash64("chain", "least").cast("decimal(20,0)"))).first()) != seen:
        seen, last = now, state
        state = _doubled(state, "ring-least")
        removed(last)
    rings = state.select("chain", F.col("least").alias("ring"))
    # Cut before the least chain; what lies behind each chain is the way to the cut.
    cut = onward.join(rings, "chain").withColumn("to", F.when(F.col("to") != F.col("ring"), F.col("to")))
    far = written(cut.select("chain", "to", F.col("ring").alias("least"), F.col("size").alias("far")), "ring-far")
    while far.where("to IS NOT NULL").limit(1).count():
        last, far = far, _doubled(far, "ring-far")
        removed(last)
    total = onward.join(rings, "chain").groupBy("ring").agg(F.sum("size").alias("total"))
    return rings.join(far.select("chain", "far"), "chain").join(total, "ring").select("chain", "ring", (F.col("total") - F.col("far")).alias("before"))


def corners(labelled: DataFrame, tile: int = TILE) -> DataFrame:
    """(patch, ring, place, row, col): corners of each ring in order, for cells (scene, row, col, patch)."""
    # Edges are numbered by four for each cell, which leaves two bits less for the scene.
    number = F.when(F.col("scene") < 1 << 21, cell_id(F.col("scene"), F.col("row"), F.col("col"))).otherwise(F.raise_error(F.lit("rings of scenes from 2**21 on")))
    cells = labelled.select(number.alias("cell"), "scene", "row", "col", "patch")
    # A cell goes to its own tile and, as border, to those that its neighbours lie in.
    near = [F.struct(F.floor((F.col("row") + i) / tile).alias("t_row"), F.floor((F.col("col") + j) / tile).alias("t_col")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    dealt = cells.select("cell", "patch", "scene", F.floor(F.col("row") / tile).alias("o_row"), F.floor(F.col("col") / tile).alias("o_col"), F.explode(F.array_distinct(F.array(*near))).alias("t"))
    dealt = dealt.select("cell", "patch", "scene", "t.t_row", "t.t_col", ((F.col("t.t_row") == F.col("o_row")) & (F.col("t.t_col") == F.col("o_col"))).alias("own"))
    found = written(over_tiles(dealt, _traced(tile), _CHAIN), "ring-edges")
    placed = _placed(found.where("kind = 'link'").select("chain", "head", "follows", "size"))
    closed = found.where("kind = 'ring'").select("patch", F.col("chain").alias("ring"), "place", "row", "col")
    over = found.where("kind = 'chain'").join(placed, "chain").select("patch", "ring", (F.col("before") + F.col("place")).alias("place"), "row", "col")
    return closed.unionByName(over)


def rings(labelled: DataFrame, tile: int = TILE) -> DataFrame:
    """(patch, ring, hole, cells, points): each ring closed, from its topmost and then leftmost corner on; ``cells`` is its
    area, negative for holes; ``ring`` is a number without a meaning."""
    listed = corners(labelled, tile).groupBy("patch", "ring").agg(F.array_sort(F.collect_list(F.struct("place", "row", "col"))).alias("c"))
    point = F.transform("c", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col")))
    out = listed.select("patch", "ring", point.alias("p")).withColumn("n", F.size("p"))
    begin = F.array_position("p", F.array_min("p")).cast("int")
    out = out.withColumn("p", F.concat(F.slice("p", begin, F.col("n")), F.slice("p", F.lit(1), begin - 1), F.slice("p", begin, 1)))
    step = lambda i: F.get("p", i)["col"] * F.get("p", i + 1)["row"] - F.get("p", i + 1)["col"] * F.get("p", i)["row"]
    twice = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0).cast("long"), lambda a, i: a + step(i))
    out = out.withColumn("cells", (twice / 2).cast("long"))
    return out.select("patch", "ring", (F.col("cells") < 0).alias("hole"), "cells", F.col("p").alias("points"))


def polygon_text(points: str, x: Callable[[Column], Column], y: Callable[[Column], Column]) -> Column:
    """The coordinates of a ring as JSON text; ``x`` and ``y`` are made of a point's fields by functions of it."""
    return F.concat(F.lit("["), F.array_join(F.transform(points, lambda p: F.concat(F.lit("["), x(p).cast("string"), F.lit(","), y(p).cast("string"), F.lit("]"))), ","), F.lit("]"))


def polygons(found: DataFrame) -> DataFrame:
    """(patch, holes, cells, coordinates) of ``rings``: a patch as a GeoJSON polygon of its column and row borders, outer
    ring first, holes by where they begin."""
    found = found.withColumn("text", polygon_text("points", lambda p: p["col"], lambda p: p["row"]))
    ordered = F.array_sort(F.collect_list(F.struct("hole", F.get("points", F.lit(0)).alias("at"), "text")))
    texts = F.transform(ordered, lambda r: r["text"])
    return found.groupBy("patch").agg(F.count_if("hole").alias("holes"), F.sum("cells").alias("cells"), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("coordinates"))
