"""Spatial joins of boxes (x0, y0, x1, y1), closed: touching edges and corners intersect.

Boxes are laid into square buckets and joined by bucket and by further equal keys; a pair is kept only in the
bucket of the lower left corner of what the boxes share, so nothing has to be made distinct. A bare range
condition would be a nested loop over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, LISTED = 64, 256


def _spread(df: DataFrame, side: str, columns: tuple[str, ...], size: int, reach: float) -> DataFrame:
    low = lambda c: F.floor((F.col(c) - reach) / size)
    high = lambda c: F.floor((F.col(c) + reach) / size)
    x = F.sequence(low("x0"), high("x1"))
    y = F.sequence(low("y0"), high("y1"))
    out = df.select(*[F.col(c).alias(f"{side}_{c}") for c in columns], F.explode(x).alias("bx"), y.alias("ys"))
    return out.select("*", F.explode("ys").alias("by")).drop("ys")


def gap(a: str = "l", b: str = "r") -> Column:
    """Distance of two boxes, 0 where they touch."""
    dx = F.greatest(F.lit(0), F.col(f"{a}_x0") - F.col(f"{b}_x1"), F.col(f"{b}_x0") - F.col(f"{a}_x1"))
    dy = F.greatest(F.lit(0), F.col(f"{a}_y0") - F.col(f"{b}_y1"), F.col(f"{b}_y0") - F.col(f"{a}_y1"))
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def contains(a: str = "l", b: str = "r") -> Column:
    c = F.col
    return (c(f"{a}_x0") <= c(f"{b}_x0")) & (c(f"{a}_y0") <= c(f"{b}_y0")) & (c(f"{a}_x1") >= c(f"{b}_x1")) & (c(f"{a}_y1") >= c(f"{b}_y1"))


def near_pairs(left: DataFrame, right: DataFrame, equal: tuple[str, ...] = (), within: float = 0.0, size: int = BUCKET) -> DataFrame:
    """Pairs with columns l_* and r_* whose boxes touch or lie at most ``within`` apart."""
    a = _spread(left, "l", tuple(left.columns), size, within)
    b = _spread(right, "r", tuple(right.columns), size, 0.0)
    on = (a.bx == b.bx) & (a.by == b.by)
    for k in equal:
        on = on & (a[f"l_{k}"] == b[f"r_{k}"])
    corner_x = F.floor(F.greatest(F.col("l_x0") - within, F.col("r_x0")) / size)
    corner_y = F.floor(F.greatest(F.col("l_y0") - within, F.col("r_y0")) / size)
    pairs = a.join(b, on).where((a.bx == corner_x) & (a.by == corner_y)).drop("bx", "by")
    return pairs.where(gap() <= within)


def listed(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys…, ids): the ids of rows with equal keys, at most ``LISTED`` in one list, so that what is seen at one place
    again and again is compared once; ``spelled`` tells the pairs."""
    line = Window.partitionBy(*keys).orderBy("id")
    dealt = rows.select("id", *keys, F.floor((F.row_number().over(line) - 1) / LISTED).alias("part"))
    return dealt.groupBy(*keys, "part").agg(F.collect_list("id").alias("ids")).drop("part")


def spelled(pairs: DataFrame) -> DataFrame:
    """(l_id, r_id) of pairs of lists (l_ids, r_ids). Pairs are told where their lists meet, none goes through a shuffle."""
    return pairs.select(F.explode("l_ids").alias("l_id"), "r_ids").select("l_id", F.explode("r_ids").alias("r_id"))
