"""Shapes of straight edges: which of them meet, which lie within which, how far apart they are, which cells they cover.

A shape is its edges (id, part, ax, ay, bx, by, filled): rings of polygons, lines, or points as edges of no length. What lies
inside an odd number of a shape's rings belongs to it if it is ``filled``. Everything is joins of edges:

* Edges are laid along the cells of a grid that they run through, and tested only against edges of the same cell.
* A shape whose edges meet none of another lies wholly inside or outside of it, part by part, so one probe of each part
  tells. A probe counts the edges to its right, and meets only those in its own band of rows.
* One shape contains another if no piece of the other's outline, cut where outlines meet, is outside, and none
  of its own is inside the other. Only pairs whose outlines touch without crossing need the cuts.
* For distances, edges are grouped by cell; the groups' boxes bound what is between them, and only groups that can
  hold the nearest pair of edges are opened.

Arithmetic is in doubles: exact for coordinates on a grid, elsewhere an outline counts as met within ``NEAR`` of its size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.functions.geometry import geodesic_m, local_scales
from landshift.operators.boxes import near_pairs
from landshift.sources.shared import written

NEAR = 1e-12

_POINT = "array<double>"
_DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def edges(shapes: DataFrame, id_col: str = "id", type_col: str = "geometry_type", text_col: str = "coordinates", *keys: str) -> DataFrame:
    """(id, part, ax, ay, bx, by, filled, keys…) of GeoJSON coordinate texts; a null, empty or unreadable one has none."""
    nested = lambda depth: F.from_json(text_col, "array<" * (depth - 1) + _POINT + ">" * (depth - 1))
    kind = F.col(type_col)
    parts = (
        F.when(kind == "Polygon", nested(3)).when(kind == "MultiPolygon", F.flatten(nested(4))).when(kind == "LineString", F.array(nested(2)))
        .when(kind == "MultiLineString", nested(3)).when(kind == "Point", F.array(F.array(nested(1)))).when(kind == "MultiPoint", F.transform(nested(2), lambda p: F.array(p)))
    )
    rows = shapes.select(F.col(id_col).alias("id"), *keys, kind.isin("Polygon", "MultiPolygon").alias("filled"), F.posexplode(parts).alias("part", "p"))
    last = F.greatest(F.size("p") - 2, F.lit(0))
    pairs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get("p", i).alias("a"), F.coalesce(F.get("p", i + 1), F.get("p", i)).alias("b")))
    rows = rows.where(F.size("p") > 0).select("id", *keys, "filled", F.col("part").cast("long").alias("part"), F.explode(pairs).alias("e"))
    at = lambda end, k: F.get(F.col(f"e.{end}"), F.lit(k)).alias(f"{end}{'xy'[k]}")
    return rows.select("id", "part", at("a", 0), at("a", 1), at("b", 0), at("b", 1), "filled", *keys).where("ax IS NOT NULL AND ay IS NOT NULL AND bx IS NOT NULL AND by IS NOT NULL")


def outlines(shapes: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(shapes, members): each outline once, under the least id that has it, and (id, of) of all ids.

    Shapes of the same edges (and ``keys``) meet and hold the same others, so what is told of one is told of all."""
    columns = ("part", "ax", "ay", "bx", "by", "filled", *keys)
    listed = written(shapes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("outline")), "outlines")
    first = written(listed.groupBy("outline").agg(F.min("id").alias("of")), "outlines")
    members = written(listed.join(first, "outline").select("id", "of"), "outline-members")
    return first.select(F.col("of").alias("id"), F.explode("outline").alias("e")).select("id", "e.*"), members


def for_members(pairs: DataFrame, members: DataFrame, side: str) -> DataFrame:
    """Pairs of ``outlines`` (l_id, r_id, …) for every id that has the outline on that side."""
    return pairs.withColumnRenamed(side, "of").join(members.withColumnRenamed("id", side), "of").drop("of")


def _cells(rows: DataFrame, size: float) -> DataFrame:
    """``rows`` of edges once for each grid cell (gx, gy) that they run through."""
    x0, x1 = F.least("ax", "bx"), F.greatest("ax", "bx")
    y0, y1 = F.least("ay", "by"), F.greatest("ay", "by")
    cut = rows.withColumn("gx", F.explode(F.sequence(F.floor(x0 / size), F.floor(x1 / size))))
    # Where the edge is while it is in this column of cells; an upright one is there with all its length.
    slope = F.try_divide(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    at = lambda x: F.greatest(y0, F.least(y1, F.col("ay") + (x - F.col("ax")) * slope))
    one, two = at(F.greatest(x0, F.col("gx") * size)), at(F.least(x1, (F.col("gx") + 1) * size))
    slack = (y1 - y0) * NEAR
    upright = F.col("ax") == F.col("bx")  # least() and greatest() would pass its null slope over
    low, high = F.when(upright, y0).otherwise(F.least(one, two) - slack), F.when(upright, y1).otherwise(F.greatest(one, two) + slack)
    return cut.withColumn("gy", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))


def _side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """Which side of the line p-q a point lies on: -1, 0 or 1."""
    value = (qx - px) * (ry - py) - (qy - py) * (rx - px)
    size = F.abs((qx - px) * (ry - py)) + F.abs((qy - py) * (rx - px))
    return F.when(F.abs(value) <= size * NEAR, 0).otherwise(F.signum(value).cast("int"))


def _ends(side: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{side}_{c}") for c in ("ax", "ay", "bx", "by"))


def _within_box(a: tuple[Column, ...], x: Column, y: Column) -> Column:
    return x.between(F.least(a[0], a[2]), F.greatest(a[0], a[2])) & y.between(F.least(a[1], a[3]), F.greatest(a[1], a[3]))


def meetings(left: DataFrame, right: DataFrame, size: float, equal: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of edges (l_*, r_*) that meet, with ``crossing``: they cross in the midst of both. A pair that meets in
    several cells comes as often."""
    a, b = (_cells(df, size).select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns], F.col("gx").alias(f"{s}_gx"), F.col("gy").alias(f"{s}_gy")) for df, s in ((left, "l"), (right, "r")))
    on = (F.col("l_gx") == F.col("r_gx")) & (F.col("l_gy") == F.col("r_gy"))
    for k in equal:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    l, r = _ends("l"), _ends("r")  # noqa: E741
    pairs = a.join(b, on).withColumns({"s1": _side(*l, r[0], r[1]), "s2": _side(*l, r[2], r[3]), "s3": _side(*r, l[0], l[1]), "s4": _side(*r, l[2], l[3])})
    crossing = (F.col("s1") * F.col("s2") < 0) & (F.col("s3") * F.col("s4") < 0)
    touch = ((F.col("s1") == 0) & _within_box(l, r[0], r[1])) | ((F.col("s2") == 0) & _within_box(l, r[2], r[3])) | ((F.col("s3") == 0) & _within_box(r, l[0], l[1])) | ((F.col("s4") == 0) & _within_box(r, l[2], l[3]))
    return pairs.where(crossing | touch).withColumn("crossing", crossing).drop("s1", "s2", "s3", "s4", "l_gx", "l_gy", "r_gx", "r_gy")


def located(probes: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """``probes`` (shape, x, y, …) with ``inside`` (strictly within an odd number of rings) and ``on`` (on an outline) of the
    shape that each names. Probes are distinct: they are told apart by all their columns."""
    y0, y1 = F.least("ay", "by"), F.greatest("ay", "by")
    bands = shapes.where("filled").select(F.col("id").alias("shape"), "ax", "ay", "bx", "by", F.explode(F.sequence(F.floor(y0 / size), F.floor(y1 / size))).alias("band"))
    asked = probes.withColumn("band", F.floor(F.col("y") / size))
    met = asked.join(bands, ["shape", "band"], "left")
    x, y, ends = F.col("x"), F.col("y"), tuple(F.col(c) for c in ("ax", "ay", "bx", "by"))
    on = (_side(*ends, x, y) == 0) & _within_box(ends, x, y)
    # An edge counts with its lower end and without its upper one, so a corner counts once or twice as it should.
    above = (F.col("ay") > y) != (F.col("by") > y)
    right = x < F.col("ax") + (y - F.col("ay")) * F.try_divide(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    found = met.groupBy(*probes.columns).agg((F.count_if(above & right) % 2 == 1).alias("odd"), F.coalesce(F.bool_or(on), F.lit(False)).alias("on"))
    return found.select(*probes.columns, (F.col("odd") & ~F.col("on")).alias("inside"), "on")


def _boxes(shapes: DataFrame, *keys: str) -> DataFrame:
    low, high = (lambda c: F.min(F.least(f"a{c}", f"b{c}")).alias(f"{c}0")), (lambda c: F.max(F.greatest(f"a{c}", f"b{c}")).alias(f"{c}1"))
    return shapes.groupBy(*keys).agg(low("x"), low("y"), high("x"), high("y"), F.min_by(F.struct("ax", "ay"), F.struct("ax", "ay")).alias("p"))


def _probes(parts: DataFrame, whole: DataFrame, size: float, equal: tuple[str, ...]) -> DataFrame:
    """(shape, other, part, x, y): a point of each part of ``other``, for shapes whose box it lies in."""
    points = parts.select("id", "part", *equal, F.col("p.ax").alias("x0"), F.col("p.ay").alias("y0"), F.col("p.ax").alias("x1"), F.col("p.ay").alias("y1"))
    pairs = near_pairs(points, whole, equal, 0.0, size)
    return pairs.select(F.col("r_id").alias("shape"), F.col("l_id").alias("other"), F.col("l_part").alias("part"), F.col("l_x0").alias("x"), F.col("l_y0").alias("y"))


def relations(left: DataFrame, right: DataFrame, size: float, equal: tuple[str, ...] = ()) -> DataFrame:
    """(l_id, r_id, contains): pairs of shapes that share a point, and whether the right one contains the left one.

    ``size``: of the grid's cells, about the length of an edge. Only a filled shape contains others, and only such as
    don't lie on its outline alone.
    """
    met = written(meetings(left.select("id", "part", "ax", "ay", "bx", "by", *equal), right.select("id", "part", "ax", "ay", "bx", "by", *equal), size, equal).distinct(), "shape-meetings")
    outlines = met.groupBy("l_id", "r_id").agg(F.bool_or("crossing").alias("crossing"))
    l_parts, r_parts = (_boxes(s, "id", "part", *equal) for s in (left, right))
    l_filled, r_filled = (_boxes(s.where("filled"), "id", *equal) for s in (left, right))
    of_left = located(_probes(l_parts, r_filled, size, equal), right, size).where("inside OR on").select(F.col("other").alias("l_id"), F.col("shape").alias("r_id"), F.lit(1).alias("l_in"), F.lit(0).alias("r_in"))
    of_right = located(_probes(r_parts, l_filled, size, equal), left, size).where("inside OR on").select(F.col("shape").alias("l_id"), F.col("other").alias("r_id"), F.lit(0).alias("l_in"), F.lit(1).alias("r_in"))
    probed = of_left.unionByName(of_right).groupBy("l_id", "r_id").agg(F.sum("l_in").alias("l_in"), F.sum("r_in").alias("r_in"))
    pairs = written(outlines.join(probed, ["l_id", "r_id"], "full").na.fill(0, ["l_in", "r_in"]), "shape-pairs")
    count = left.groupBy(F.col("id").alias("l_id")).agg(F.countDistinct("part").alias("parts"))
    # Outlines apart: contained if all its parts are inside and no ring of the other is.
    apart = pairs.where("crossing IS NULL").join(count, "l_id").select("l_id", "r_id", ((F.col("l_in") == F.col("parts")) & (F.col("r_in") == 0)).alias("contains"))
    crossed = pairs.where("crossing").select("l_id", "r_id", F.lit(False).alias("contains"))
    touching = pairs.where("NOT crossing").select("l_id", "r_id").join(right.where("filled").select(F.col("id").alias("r_id")).distinct(), "r_id", "left_semi")
    lines = pairs.where("NOT crossing").join(touching, ["l_id", "r_id"], "left_anti").select("l_id", "r_id", F.lit(False).alias("contains"))
    return apart.unionByName(crossed).unionByName(lines).unionByName(_contained(written(touching, "shape-touching"), met, left, right, size))


def _pieces(pairs: DataFrame, met: DataFrame, shapes: DataFrame, own: str, other: str) -> DataFrame:
    """(l_id, r_id, x, y): the middle of each piece of the outlines of ``own`` shapes, cut where they meet the other's."""
    a, b = _ends(own), _ends(other)
    dx, dy = a[2] - a[0], a[3] - a[1]
    length = dx * dx + dy * dy
    along = lambda x, y: F.try_divide((x - a[0]) * dx + (y - a[1]) * dy, length)
    ends = [F.when((_side(*a, x, y) == 0) & _within_box(a, x, y), along(x, y)) for x, y in ((b[0], b[1]), (b[2], b[3]))]
    cuts = met.join(pairs, ["l_id", "r_id"]).groupBy("l_id", "r_id", *[f"{own}_{c}" for c in ("ax", "ay", "bx", "by")]).agg(F.flatten(F.collect_list(F.array(*ends))).alias("cuts"))
    lines = pairs.join(shapes.select(F.col("id").alias(f"{own}_id"), *[F.col(c).alias(f"{own}_{c}") for c in ("ax", "ay", "bx", "by")]), f"{own}_id")
    keys = ["l_id", "r_id", *[f"{own}_{c}" for c in ("ax", "ay", "bx", "by")]]
    every = lines.join(cuts, keys, "left").withColumn("t", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce(F.array_compact("cuts"), F.array().cast("array<double>"))))))
    middle = F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: (F.get("t", i) + F.get("t", i + 1)) / 2)
    piece = every.select("l_id", "r_id", F.explode(middle).alias("m"), *a)
    return piece.select("l_id", "r_id", (a[0] + F.col("m") * dx).alias("x"), (a[1] + F.col("m") * dy).alias("y"), dx.alias("dx"), dy.alias("dy")).distinct()


def _contained(pairs: DataFrame, met: DataFrame, left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """``relations`` of pairs whose outlines touch and don't cross.

    Where the left outline lies on the right one with all its pieces, points just beside them tell whether what the
    left shape encloses belongs to the right one; a line or point on an outline is not contained."""
    mine = written(located(_pieces(pairs, met, left, "l", "r").withColumn("shape", F.col("r_id")), right, size), "shape-pieces")
    theirs = located(_pieces(pairs, met, right, "r", "l").withColumn("shape", F.col("l_id")), left, size).select("l_id", "r_id", F.col("inside").alias("out"))
    upon = mine.groupBy("l_id", "r_id").agg(F.bool_and("on").alias("upon")).where("upon").select("l_id", "r_id")
    step = F.explode(F.array(F.lit(-1e-7), F.lit(1e-7))).alias("step")
    beside = mine.join(upon, ["l_id", "r_id"]).select("l_id", "r_id", "x", "y", "dx", "dy", step)
    beside = written(beside.select("l_id", "r_id", (F.col("x") - F.col("step") * F.col("dy")).alias("x"), (F.col("y") + F.col("step") * F.col("dx")).alias("y")).distinct(), "shape-beside")
    within = located(located(beside.withColumn("shape", F.col("l_id")), left, size).select("l_id", "r_id", "x", "y", F.col("inside").alias("own"), F.col("r_id").alias("shape")), right, size)
    within = within.select("l_id", "r_id", (F.col("own") & ~F.col("inside")).alias("out"))
    hollow = upon.join(left.where("NOT filled").select(F.col("id").alias("l_id")).distinct(), "l_id", "left_semi").withColumn("out", F.lit(True))
    told = mine.select("l_id", "r_id", (~F.col("inside") & ~F.col("on")).alias("out")).unionByName(theirs).unionByName(within).unionByName(hollow)
    return told.groupBy("l_id", "r_id").agg((~F.bool_or("out")).alias("contains"))


def nearest(left: DataFrame, right: DataFrame, within_m: float, size: float, equal: tuple[str, ...] = ()) -> DataFrame:
    """(l_id, r_id, distance_m): pairs of shapes in degrees of longitude and latitude whose outlines are at most
    ``within_m`` apart. For shapes that share no point; whether they do is told by ``relations``.

    The nearest points of two edges are found in a plane that is true to scale between them; between those points
    the distance is that of the geodesic. Degrees of longitude shrink to the poles: the reach is that of the shapes' highest latitude.
    """
    top = left.unionByName(right, allowMissingColumns=True).agg(F.max(F.greatest(F.abs("ay"), F.abs("by")))).first()[0]
    reach = within_m / (110_000.0 * max(math.cos(math.radians(min(top or 0.0, 89.0))), 0.01))

    def grouped(shapes: DataFrame) -> DataFrame:
        at = [F.floor((F.col(f"a{c}") + F.col(f"b{c}")) / 2 / size).alias(f"m{c}") for c in "xy"]
        return _boxes_with_edges(shapes.select("*", *at), "id", "mx", "my", *equal)

    pairs = near_pairs(grouped(left), grouped(right), equal, reach * 1.5, max(size, reach))
    lat = (F.col("l_y0") + F.col("r_y1")) / 2
    sx, sy = local_scales(lat)
    gap = lambda c, s: F.greatest(F.lit(0.0), F.col(f"l_{c}0") - F.col(f"r_{c}1"), F.col(f"r_{c}0") - F.col(f"l_{c}1")) * s
    reachable = F.hypot(gap("x", sx), gap("y", sy))
    far = F.hypot((F.col("l_p.ax") - F.col("r_p.ax")) * sx, (F.col("l_p.ay") - F.col("r_p.ay")) * sy)
    # Bounds are of a plane for each pair of groups; they differ by far less than the slack.
    bound = pairs.select("l_id", "r_id", "l_edges", "r_edges", (reachable * 0.98).alias("low"), (far * 1.02).alias("high")).where(F.col("low") <= within_m)
    best = bound.groupBy("l_id", "r_id").agg(F.min("high").alias("most"))
    kept = bound.join(best, ["l_id", "r_id"]).where("low <= most")
    both = kept.select("l_id", "r_id", F.explode("l_edges").alias("a"), "r_edges").select("l_id", "r_id", "a", F.explode("r_edges").alias("b"))
    near = _feet(both).groupBy("l_id", "r_id").agg(F.min(F.struct("d", "px", "py", "qx", "qy")).alias("n"))
    metres = geodesic_m(F.col("n.px"), F.col("n.py"), F.col("n.qx"), F.col("n.qy"))
    return near.select("l_id", "r_id", metres.alias("distance_m")).where(F.col("distance_m") <= within_m)


def _boxes_with_edges(shapes: DataFrame, *keys: str) -> DataFrame:
    low, high = (lambda c: F.min(F.least(f"a{c}", f"b{c}")).alias(f"{c}0")), (lambda c: F.max(F.greatest(f"a{c}", f"b{c}")).alias(f"{c}1"))
    edge = F.struct("ax", "ay", "bx", "by")
    return shapes.groupBy(*keys).agg(low("x"), low("y"), high("x"), high("y"), F.min_by(F.struct("ax", "ay"), F.struct("ax", "ay")).alias("p"), F.collect_set(edge).alias("edges"))


def _feet(pairs: DataFrame) -> DataFrame:
    """(l_id, r_id, d, px, py, qx, qy): for each end of two edges a and b the nearest point of the other edge, and their
    distance in metres in a plane true to scale there. Edges that don't cross are nearest at an end of one of them."""
    end = lambda e, k, of: F.struct(F.col(f"{e}.{k}x").alias("px"), F.col(f"{e}.{k}y").alias("py"), F.col(of).alias("e"))
    rows = pairs.select("l_id", "r_id", F.explode(F.array(end("a", "a", "b"), end("a", "b", "b"), end("b", "a", "a"), end("b", "b", "a"))).alias("p")).select("l_id", "r_id", "p.px", "p.py", "p.e.*")
    sx, sy = local_scales(F.col("py"))
    rows = rows.withColumns({"sx": sx, "sy": sy})
    rows = rows.withColumns({"dx": (F.col("bx") - F.col("ax")) * F.col("sx"), "dy": (F.col("by") - F.col("ay")) * F.col("sy")})
    along = F.try_divide((F.col("px") - F.col("ax")) * F.col("sx") * F.col("dx") + (F.col("py") - F.col("ay")) * F.col("sy") * F.col("dy"), F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    rows = rows.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0)))))
    rows = rows.withColumns({"qx": F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), "qy": F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))})
    return rows.select("l_id", "r_id", F.hypot((F.col("px") - F.col("qx")) * F.col("sx"), (F.col("py") - F.col("qy")) * F.col("sy")).alias("d"), "px", "py", "qx", "qy")


def spans(shapes: DataFrame, *keys: str) -> DataFrame:
    """(id, keys…, row, c0, c1): runs of the unit cells whose centre is inside a filled shape, row by row.

    A row's centre line crosses a shape's outline an even number of times; what lies between the first and the
    second crossing is inside, and so on. A centre on an outline counts where it is the left or upper one.
    """
    y0, y1 = F.least("ay", "by"), F.greatest("ay", "by")
    # Lines at row + 1/2 that the edge crosses, its lower end included and its upper one not.
    first, last = F.ceil(y0 - 0.5), F.ceil(y1 - 0.5) - 1
    rows = shapes.where("filled AND ay != by").where(first <= last).select("id", *keys, "ax", "ay", "bx", "by", F.explode(F.sequence(first, last)).alias("row"))
    x = F.col("ax") + (F.col("row") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    lines = rows.groupBy("id", *keys, "row").agg(F.array_sort(F.collect_list(x)).alias("x"))
    turn = F.transform(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2)), lambda i: F.struct(F.ceil(F.get("x", i) - 0.5).alias("c0"), F.ceil(F.get("x", i + 1) - 0.5).alias("c1")))
    return lines.select("id", *keys, "row", F.explode(turn).alias("s")).select("id", *keys, "row", "s.c0", "s.c1").where("c0 < c1")
