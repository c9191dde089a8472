"""Confidence of events by a transparent weighted rule, as column expressions.

Factors lie between 0 and 1; a missing one is null, leaves the weighted mean, and is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landshift.functions.text import clamped
from landshift.operators.boxes import near_pairs
from landshift.operators.footprints import touching

# Fixed values of the rule.
WEIGHTS = {"magnitude": 0.25, "persistence": 0.20, "coverage": 0.10, "currency": 0.10, "agreement": 0.15, "stability": 0.20}
HIGH, MEDIUM = 0.65, 0.4
AGREEMENT_DAYS = 30
STABILITY = {"persistent": 1.0, "recovering": 0.5, "transient": 0.0}


def magnitude(delta: Column) -> Column:
    return clamped((F.abs(delta) - 0.1) / 0.4)


def persistence(measurements: Column) -> Column:
    return clamped((measurements - 1) / 4.0)


def currency(days: Column) -> Column:
    return clamped(1 - days / 180.0)


def stability(state: Column) -> Column:
    return F.coalesce(*[F.when(state == s, F.lit(v)) for s, v in STABILITY.items()])


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def weighted(df: DataFrame) -> DataFrame:
    """``df`` with score (4 digits; ties are ties whatever the order of the sum), level and the sorted list of missing factors, from columns named as ``WEIGHTS``."""
    zero = F.lit(0.0)
    total = sum((F.when(F.col(f).isNotNull(), F.lit(w)).otherwise(zero) for f, w in WEIGHTS.items()), zero)
    value = sum((F.coalesce(F.col(f) * w, zero) for f, w in WEIGHTS.items()), zero)
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in sorted(WEIGHTS)]))
    out = df.withColumn("score", F.round(F.round(F.when(total > 0, value / total).otherwise(zero), 9), 4))
    return out.withColumns({"level": level(F.col("score")), "missing": F.array_join(missing, ",")})


def event_stats(links: DataFrame, candidates: DataFrame) -> DataFrame:
    rows = links.select("event_id", "candidate_id").join(candidates.withColumnRenamed("id", "candidate_id"), "candidate_id")
    return rows.groupBy("event_id").agg(F.min("delta_min").alias("delta_min"), F.avg("delta_mean").alias("delta_mean"), F.avg("valid_pixel_fraction").alias("mean_valid_fraction"), F.count("*").alias("measurements"))


def own_kinds(links: DataFrame, candidates: DataFrame, observations: DataFrame, sensors: DataFrame) -> DataFrame:
    """(event_id, kinds): the distinct sensor kinds of an event's measurements; sensors is the small registry."""
    rows = links.select("event_id", "candidate_id").join(candidates.select(F.col("id").alias("candidate_id"), F.col("change_raster_id").alias("observation_id")), "candidate_id")
    rows = rows.join(observations.select(F.col("id").alias("observation_id"), "sensor"), "observation_id").join(sensors, F.col("sensor") == sensors.name)
    return rows.groupBy("event_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def agreement(events: DataFrame, kinds: DataFrame, observations: DataFrame, candidates: DataFrame, days: int = AGREEMENT_DAYS, footprints: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(event_id, other_observations, matches, agreement, basis): what the other kind of sensor saw around an event.

    ``observations`` and ``candidates`` carry the sensor kind. Looks of the other kind are counted up to each day of
    an area; an event meets only the days its span begins and ends on. Candidates meet events by place, then time:
    by their boxes, or by ``footprints``, runs (id, row, c0, c1) of the events and of the candidates.
    """
    known = events.join(kinds.where(F.size("kinds") == 1).select(F.col("event_id").alias("id"), F.col("kinds")[0].alias("own_kind")), "id", "left")
    known = known.withColumn("other_kind", F.when(F.col("own_kind") == "optical", "radar").when(F.col("own_kind").isNotNull(), "optical"))
    span = known.withColumns({"from_at": F.col("first_detected_at") - F.expr(f"INTERVAL {days} DAYS"), "to_at": F.col("last_detected_at") + F.expr(f"INTERVAL {days} DAYS")})
    seen = _looks_within(span.select("id", "aoi_id", F.col("other_kind").alias("kind"), "from_at", "to_at"), observations)
    theirs = span.select("id", "aoi_id", F.col("other_kind").alias("kind"), "from_at", "to_at", *[c for c in ("x0", "y0", "x1", "y1") if footprints is None])
    in_time = F.col("r_detected_at").between(F.col("l_from_at"), F.col("l_to_at"))
    if footprints is None:
        met = near_pairs(theirs, candidates.select("id", "aoi_id", "kind", "detected_at", "x0", "y0", "x1", "y1"), ("aoi_id", "kind")).where(in_time)
    else:
        met = touching(footprints[0].join(theirs, "id"), footprints[1].join(candidates.select("id", "aoi_id", "kind", "detected_at"), "id"), ("aoi_id", "kind"), in_time)
    met = met.groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias("matches"))
    out = known.select("id", "own_kind").join(seen, "id", "left").join(met, "id", "left").na.fill(0, ["other_observations", "matches"])
    own = F.col("own_kind").isNotNull()
    score = F.when(~own, None).when(F.col("matches") > 0, 1.0).when(F.col("other_observations") > 0, 0.0)
    basis = F.when(~own, None).when(F.col("matches") > 0, "both").otherwise(F.concat("own_kind", F.lit("-only")))
    return out.select(F.col("id").alias("event_id"), "other_observations", "matches", score.cast("double").alias("agreement"), basis.alias("basis"))


def _looks_within(spans: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, other_observations): looks (aoi_id, kind, acquired_at) from ``from_at`` to ``to_at``, both included."""
    by_day = observations.groupBy("aoi_id", "kind", F.to_date("acquired_at").alias("day")).agg(F.collect_list("acquired_at").alias("times"))
    last = Window.partitionBy("aoi_id", "kind").orderBy("day")
    by_day = by_day.select("*", F.coalesce(F.sum(F.size("times")).over(last.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("day").over(last).alias("next"))
    # A row for each day up to the next one with looks; the one before the first stands for all days before it.
    days = by_day.select("aoi_id", "kind", "day", "times", "before", F.explode(F.sequence(F.col("day"), F.coalesce(F.date_sub("next", 1), F.col("day")))).alias("at_day"))
    bounds = by_day.groupBy("aoi_id", "kind").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    held = spans.join(bounds, ["aoi_id", "kind"])

    def upto(moment: str, test) -> DataFrame:
        at = held.select("id", "aoi_id", "kind", F.col(moment).alias("m"), F.greatest("first", F.least("last", F.to_date(moment))).alias("at_day"))
        met = at.join(days, ["aoi_id", "kind", "at_day"])
        return met.select("id", (F.col("before") + F.size(F.filter("times", lambda t: test(t, F.col("m"))))).alias(moment))

    both = upto("from_at", lambda t, m: t < m).join(upto("to_at", lambda t, m: t <= m), "id")
    return both.select("id", (F.col("to_at") - F.col("from_at")).alias("other_observations"))


def moved(assessed: DataFrame, history: DataFrame, rule: str, digits: int = 2) -> DataFrame:
    """New assessments to append: events without one under this rule, or whose level or rounded score changed."""
    last = history.where(F.col("rule_version") == rule).groupBy("event_id").agg(F.max_by(F.struct("level", "score"), "id").alias("last"))
    both = assessed.join(last, "event_id", "left")
    changed = F.col("last").isNull() | (F.col("last.level") != F.col("level")) | (F.round("last.score", digits) != F.round("score", digits))
    return both.where(changed).drop("last")
