"""Candidates become events: greedy tracking, growth, lifecycle.

Candidates of one area and methodology are taken in the order of detection. Each joins the earliest event that
a candidate before it, which it touches, belongs to; otherwise it starts one. Bridging never merges events. As
a footprint touches a candidate exactly if one of its members does, geometry is needed only for the links
between candidates, which is a spatial join in Spark.

Taken one by one, a candidate's event is the least of the events of its earlier neighbours. So it is the
earliest starter among all candidates that a path of links, each to an earlier one, leads to -- and that needs
no order of work: all candidates take the least event their earlier neighbours have, and then what the earliest
candidate they know of has, until nothing changes. Every round is two joins; no group of candidates is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landshift.operators.boxes import near_pairs
from landshift.operators.footprints import cells as footprint_cells
from landshift.operators.footprints import corner_points, linked_at, linked_before, points, shapes, united
from landshift.sources.shared import removed, written

RESOLVE_DAYS, CLEAR_FLOOR = 90, 0.5


def _settled(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``state`` (id, jump, maybe label) when each id has the least label, and jump, of all that links (u, v, maybe first),
    from u on to v, lead to.

    label: null where an id has none of its own; without that column labels are the own jumps. jump: struct (at, id) of the
    earliest id seen along the links, the own one and the ``first`` of the links; as what is seen from there is seen from
    here, a chain is run through in rounds of the logarithm of its length, and looks at one place in one, however many
    they are. Its tables are merged: broadcast in every round, they would pass through the driver again and again.
    """
    held = [c for c in ("label", "jump") if c in state.columns]
    if "first" in edges.columns:
        # By place and not by a cast: the columns that order candidates may be without nulls in the one and not in the other.
        fields = zip(edges.schema["first"].dataType.names, state.schema["jump"].dataType.names, strict=True)
        named = F.struct(*[F.col("first")[a].alias(b) for a, b in fields])
        first = edges.select(F.col("u").alias("id"), named.alias("first")).groupBy("id").agg(F.min("first").alias("first"))
        state = state.join(first.hint("merge"), "id", "left").withColumn("jump", F.least("jump", "first")).drop("first")
    state, seen = written(state, "tracked"), None
    least = lambda: [F.least(c, f"{c}_there").alias(c) for c in held]
    while True:
        now = state.agg(F.count(held[0]).alias("n"), F.sum(F.xxhash64("id", *held).cast("decimal(20,0)")).alias("h")).first()
        if now == seen:
            return state
        seen = now
        met = edges.select("u", "v").join(state.select(F.col("id").alias("v"), *held).hint("merge"), "v")
        near = met.groupBy(F.col("u").alias("id")).agg(*[F.min(c).alias(f"{c}_there") for c in held])
        after = written(state.join(near.hint("merge"), "id", "left").select("id", *least()), "tracked")
        onward = after.select(F.col("id").alias("at"), *[F.col(c).alias(f"{c}_there") for c in held])
        jumped = after.join(onward.hint("merge"), F.col("jump.id") == F.col("at")).select("id", *least())
        last, state = state, written(jumped, "tracked")
        removed(last)
        removed(after)


def _order(side: str):
    return F.struct(F.col(f"{side}_detected_at"), F.col(f"{side}_id"))


_PLACE = ("id", "aoi_id", "methodology_id", "detected_at")
_SAME = ("aoi_id", "methodology_id")
_BOX = ("x0", "y0", "x1", "y1")


def _placed(candidates: DataFrame, footprints: DataFrame, *more: str) -> DataFrame:
    """Runs of the candidates' footprints with what orders and separates them."""
    return footprints.withColumnRenamed("candidate_id", "id").join(candidates.select(*_PLACE, *more), "id")


def _box_links(candidates: DataFrame) -> DataFrame:
    """(u, v): links of candidates to earlier ones whose boxes they meet, enough to reach all of these."""
    slim = candidates.select(*_PLACE, *_BOX)
    if all(slim.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in _BOX):
        return linked_at(corner_points(slim, _PLACE, _SAME), ("detected_at", "id"), _SAME)
    pairs = near_pairs(slim, slim, _SAME).where(_order("l") > _order("r"))
    return pairs.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


def _ranked(events: DataFrame) -> DataFrame:
    """Events (id, at, aoi_id, methodology_id) with their place among those of the same area and methodology: the least
    number is found without sorting rows."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(*_SAME).orderBy("at", "id")))


def _named(best: DataFrame, ranked: DataFrame, *keys: str) -> DataFrame:
    """(keys…, label): places as structs (at, id) of events."""
    return best.join(ranked.select(*_SAME, "place", F.struct("at", "id").alias("label")), [*_SAME, "place"]).select(*keys, "label")


def _earliest_by_cells(rows: DataFrame, event_rows: DataFrame, events: DataFrame) -> DataFrame:
    """(id, label): the earliest event that shares a grid point with each of the footprints ``rows`` (id, row, c0, c1).
    Equal footprints are looked up once, and of the events at a point only the earliest counts."""
    ranked, at = _ranked(events), [*_SAME, "p_row", "p_col"]
    kinds, of = shapes(rows, *_SAME)
    placed = event_rows.select("id", *_SAME, "row", "c0", "c1").distinct().join(ranked.select("id", *_SAME, "place"), ["id", *_SAME])
    taken = points(placed, *_SAME, "place").groupBy(*at).agg(F.min("place").alias("place"))
    best = points(kinds, "id", *_SAME).join(taken, at).groupBy(F.col("id").alias("of"), *_SAME).agg(F.min("place").alias("place"))
    return of.join(_named(best, ranked, "of"), "of").select("id", "label")


def _earliest_by_boxes(boxes: DataFrame, event_boxes: DataFrame, events: DataFrame) -> DataFrame:
    """(id, label): the earliest event that has a box which each of ``boxes`` meets; equal boxes meet once."""
    ranked, key = _ranked(events), [*_SAME, *_BOX]
    placed = event_boxes.select("id", *key).join(ranked.select("id", *_SAME, "place"), ["id", *_SAME]).groupBy(*key).agg(F.min("place").alias("place"))
    met = near_pairs(boxes.select(*key).distinct(), placed, _SAME)
    best = met.groupBy(*[F.col(f"l_{c}").alias(c) for c in key]).agg(F.min("r_place").alias("place"))
    return boxes.select("id", *key).join(_named(best, ranked, *key), key).select("id", "label")


def tracked(candidates: DataFrame, footprints: DataFrame | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """(candidate_id, event_id) for candidates (id, aoi_id, methodology_id, detected_at, x0, y0, x1, y1); an event
    is named by the candidate that started it.

    footprints: runs (candidate_id, row, c0, c1). Without them a candidate is its box. ties: columns that order
    candidates of one time before their ids do; only with footprints."""
    if footprints is not None:
        edges = linked_before(_placed(candidates, footprints, *ties), ("detected_at", *ties, "id"), _SAME)
    else:
        edges = _box_links(candidates)
    own = F.struct(F.col("detected_at").alias("at"), *ties, "id")
    state = _settled(candidates.select("id", own.alias("jump")), written(edges, "touching"))
    return state.select(F.col("id").alias("candidate_id"), F.col("jump.id").alias("event_id"))


def extended(candidates: DataFrame, members: DataFrame, new: DataFrame, footprints: DataFrame | None = None) -> DataFrame:
    """(candidate_id, event_id) for the candidates ``new``, beside events that have members already.

    members: (event_id, candidate_id) of ``candidates``, which stay as they are. New candidates come after them
    whatever their dates, so a late one may move the first detection of the event it joins to before; among
    events it touches it takes the earliest, by the dates that they had before these candidates came.
    footprints: runs (candidate_id, row, c0, c1) of both. Without them a candidate is its box.
    """
    held = candidates.join(members.select(F.col("candidate_id").alias("id"), "event_id"), "id")
    first = held.groupBy("event_id").agg(F.min("detected_at").alias("at"))
    events = held.select("event_id", *_SAME).distinct().join(first, "event_id").withColumnRenamed("event_id", "id")
    if footprints is not None:
        fresh = _placed(new, footprints)
        edges = written(linked_before(fresh, ("detected_at", "id"), _SAME), "touching")
        held_rows = _placed(held, footprints, "event_id").drop("id").withColumnRenamed("event_id", "id")
        old = _earliest_by_cells(fresh, held_rows, events).withColumnRenamed("label", "old")
    else:
        edges = written(_box_links(new), "touching")
        old = _earliest_by_boxes(new, held.drop("id").withColumnRenamed("event_id", "id"), events).withColumnRenamed("label", "old")
    # Who touches something before it has no event of its own.
    moved = edges.select(F.col("u").alias("m_id")).distinct()
    own = F.struct(F.col("detected_at").alias("at"), "id")
    state = new.select("id", own.alias("jump")).join(moved, F.col("id") == F.col("m_id"), "left").join(old, "id", "left")
    state = state.select("id", F.coalesce("old", F.when(F.col("m_id").isNull(), F.col("jump"))).alias("label"), "jump")
    return _settled(state, edges).select(F.col("id").alias("candidate_id"), F.col("label.id").alias("event_id"))


def untracked(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates no event has a measurement of, with their place in the order of detection."""
    return candidates.join(links.select("candidate_id"), candidates.id == F.col("candidate_id"), "left_anti")


def earliest_touching(candidates: DataFrame, events: DataFrame, footprints: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(candidate_id, event_id): the event of the same area and methodology, earliest by first detection and id; by boxes,
    or by ``footprints``, runs (id, row, c0, c1) of the candidates and of the events."""
    if footprints is None:
        pairs = near_pairs(candidates, events, _SAME)
        return pairs.groupBy(F.col("l_id").alias("candidate_id")).agg(F.min(F.struct("r_first_detected_at", "r_id"))["r_id"].alias("event_id"))
    own = footprints[0].join(candidates.select("id", *_SAME), "id")
    theirs = footprints[1].join(events.select("id", *_SAME), "id")
    best = _earliest_by_cells(own, theirs, events.select("id", *_SAME, F.col("first_detected_at").alias("at")))
    return best.select(F.col("id").alias("candidate_id"), F.col("label.id").alias("event_id"))


def growth(members: DataFrame, cells: DataFrame, cell_area_m2: float | Column) -> DataFrame:
    """(event_id, candidate_id, growth_m2): area that each member adds to the footprint of those before it.

    cells: (candidate_id, row, col), or runs (candidate_id, row, c0, c1): of equal runs of an event only the first becomes
    cells. A cell counts for the first member that has it; the first member of an event has null. The area of a cell is a
    number, or an expression of its row where cells shrink towards the poles.
    """
    order = Window.partitionBy("event_id").orderBy("detected_at", "candidate_id")
    placed = members.withColumn("place", F.row_number().over(order))
    rows = placed.join(cells, "candidate_id")
    if "c0" in cells.columns:
        rows = footprint_cells(rows.groupBy("event_id", "row", "c0", "c1").agg(F.min("place").alias("place")), "event_id", "place")
    first = rows.groupBy("event_id", "row", "col").agg(F.min("place").alias("place"))
    area = cell_area_m2 if isinstance(cell_area_m2, Column) else F.lit(cell_area_m2)
    added = first.groupBy("event_id", "place", "row").agg(F.count("*").alias("n")).groupBy("event_id", "place").agg(F.sum(F.col("n") * area).alias("area"))
    out = placed.join(added, ["event_id", "place"], "left")
    return out.select("event_id", "candidate_id", F.when(F.col("place") > 1, F.coalesce("area", F.lit(0.0))).alias("growth_m2"))


def event_footprints(links: DataFrame, footprints: DataFrame) -> DataFrame:
    """(id, row, c0, c1): the union of the footprints of each event's members, as runs."""
    return united(links.join(footprints, "candidate_id").select(F.col("event_id").alias("id"), "row", "c0", "c1"), "id")


def summarised(members: DataFrame) -> DataFrame:
    """One row per event: status, first and last detection, members."""
    out = members.groupBy("event_id").agg(F.min("detected_at").alias("first_detected_at"), F.max("detected_at").alias("last_detected_at"), F.count("*").alias("members"))
    return out.withColumn("status", F.when(F.col("members") > 1, "ongoing").otherwise("new"))


def resolved(events: DataFrame, observations: DataFrame, quality: DataFrame, now, days: int = RESOLVE_DAYS, floor: float = CLEAR_FLOOR) -> DataFrame:
    """``events`` with the status after the lifecycle step.

    An ongoing event whose last detection is before ``now`` less ``days`` resolves if its area has a later look
    that is clear enough; for that, the latest clear look of each area is all it takes.
    """
    clear = observations.join(quality.where(F.col("valid_pixel_fraction") >= floor), observations.id == quality.observation_id)
    latest = clear.groupBy(F.col("aoi_id").alias("clear_aoi")).agg(F.max("acquired_at").alias("clear_at"))
    quiet = (F.col("status") == "ongoing") & (F.col("last_detected_at") < now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("clear_at") > F.col("last_detected_at"))
    out = events.join(latest, F.col("aoi_id") == F.col("clear_aoi"), "left")
    return out.withColumn("status", F.when(quiet, "resolved").otherwise(F.col("status"))).drop("clear_aoi", "clear_at")
