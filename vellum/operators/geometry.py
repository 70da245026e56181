"""Geometry of point chains and primitives as native expressions: lengths, directions, fits from moments, distance joins.

A chain is one row with ``pts``, its points ``(k, x, y)`` in order.  Everything about one chain is computed from its array, so
fits need no join, window or shuffle.  Distances between boxes and segments are columns over ``(x, y, w, h)`` and end points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.relational import nearest
from vellum.session import written

#: Inlier distance, scale of the confidence, and the least confidences of the cascade (fixed values).
INLIER, SCALE = 1.5, 3.0
LINE_OK, ARC_OK, CIRCLE_OK, ELLIPSE_OK, BEST_OK, STRAIGHT_OK, POLYLINE = 0.75, 0.65, 0.65, 0.55, 0.2, 0.50, 0.3
MIN_CHORD, MIN_SAGITTA, MIN_BEND = 5.0, 2.5, 0.05
CIRCLE_POINTS, ARC_POINTS, ELLIPSE_POINTS, ELLIPSE_INLIER = 4, 5, 6, 2.0
#: Line-like strokes: shortest and longest, least straightness, largest residual (fixed values).
STROKE = (5.0, 80.0, 0.70, 2.2)


def confidence(inliers: Column, rms: Column) -> Column:
    """Share of inliers times how far the residual stays below the scale."""
    return inliers * F.greatest(F.lit(0.0), 1 - rms / SCALE)


def angle_delta(a: Column, b: Column) -> Column:
    """Difference of two undirected angles in degrees, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def total(values: Column) -> Column:
    """Sum of an array; 0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def chain_steps(pts: Column) -> Column:
    """Distances between neighbouring points."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))


def first_point(pts: Column) -> Column:
    return F.get(pts, F.lit(0))


def last_point(pts: Column) -> Column:
    return F.get(pts, F.size(pts) - 1)


def chain_features(chains: DataFrame) -> DataFrame:
    """Chains with number of points, arc length, chord and straightness."""
    a, b = first_point(F.col("pts")), last_point(F.col("pts"))
    out = chains.withColumns({"n": F.size("pts").cast("bigint"), "length": total(chain_steps(F.col("pts"))), "chord": F.hypot(a["x"] - b["x"], a["y"] - b["y"])})
    return out.withColumn("straightness", F.coalesce(F.try_divide("chord", "length"), F.lit(0.0)))


def far_point(pts: Column, baseline: float) -> Column:
    """The first point at least ``baseline`` along a chain, else the last."""
    start = F.struct(F.lit(0.0).alias("run"), first_point(pts).alias("at"), F.lit(False).alias("there"))

    def walk(s: Column, p: Column) -> Column:
        run = s["run"] + F.hypot(p["x"] - s["at"]["x"], p["y"] - s["at"]["y"])
        return F.when(s["there"], s).otherwise(F.struct(run.alias("run"), p.alias("at"), (run >= baseline).alias("there")))

    return F.aggregate(pts, start, walk, lambda s: s["at"])


def leave_direction(pts: Column, baseline: float = 8.0) -> Column:
    """Direction in degrees in which a chain leaves its first point, taken over ``baseline`` pixels."""
    a, b = first_point(pts), far_point(pts, baseline)
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def largest_gap(angles: Column) -> Column:
    """``(gap, start, end)``: the largest gap between neighbouring directions of a circle; an arc over all others runs from start to end."""
    ordered = F.array_sort(angles)
    follow = F.concat(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.array(F.get(ordered, F.lit(0)) + 360.0))
    gaps = F.zip_with(ordered, follow, lambda e, s: F.struct((s - e).alias("gap"), (-e).alias("e"), s.alias("s")))
    best = F.array_max(gaps)
    return F.struct(best["gap"].alias("gap"), F.pmod(best["s"], F.lit(360.0)).alias("start"), (-best["e"]).alias("end"))


def centred(chains: DataFrame) -> DataFrame:
    """Chains with ``n``, their mean ``mx, my`` and ``uv``, the points from there."""
    own = chains.withColumns({"n": F.size("pts").cast("bigint"), "mx": total(F.transform("pts", lambda p: p["x"])) / F.size("pts"), "my": total(F.transform("pts", lambda p: p["y"])) / F.size("pts")})
    return own.withColumn("uv", F.transform("pts", lambda p: F.struct((p["x"] - F.col("mx")).alias("u"), (p["y"] - F.col("my")).alias("v"))))


def sums(names: dict[str, Callable[[Column, Column], Column]]) -> Column:
    """Sums of functions of ``u`` and ``v`` over the centred points, in one walk."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])
    return F.aggregate("uv", zero, lambda s, p: F.struct(*[(s[k] + f(p["u"], p["v"])).alias(k) for k, f in names.items()]))


MOMENTS = {"uu": lambda u, v: u * u, "uv": lambda u, v: u * v, "vv": lambda u, v: v * v, "uuu": lambda u, v: u * u * u, "uvv": lambda u, v: u * v * v, "vvv": lambda u, v: v * v * v, "vuu": lambda u, v: v * u * u}


def with_moments(chains: DataFrame) -> DataFrame:
    return centred(chains).withColumn("s", sums(MOMENTS))


def share_within(off: str, reach: float = INLIER) -> Column:
    return F.size(F.filter(off, lambda d: F.abs(d) <= reach)) / F.size(off)


def root_mean_square(off: str) -> Column:
    return F.sqrt(total(F.transform(off, lambda d: d * d)) / F.size(off))


def with_lines(chains: DataFrame) -> DataFrame:
    """Chains with moments and their total least squares line: ``theta``, line residuals, ``line_inliers``, ``line_rms``, ``line`` (confidence)."""
    own = chains.withColumn("theta", 0.5 * F.atan2(2 * F.col("s.uv"), F.col("s.uu") - F.col("s.vv")))
    own = own.withColumns({"line_off": F.transform("uv", lambda p: -p["u"] * F.sin("theta") + p["v"] * F.cos("theta")), "along": F.transform("uv", lambda p: p["u"] * F.cos("theta") + p["v"] * F.sin("theta"))})
    own = own.withColumns({"line_inliers": share_within("line_off"), "line_rms": root_mean_square("line_off")})
    return own.withColumn("line", confidence(F.col("line_inliers"), F.col("line_rms")))


def line_fits(chains: DataFrame) -> DataFrame:
    """Total least squares line of each chain, with inliers, residual, confidence and the end points of the inliers.

    Fewer than two inliers: the end points of all points.
    """
    own = with_lines(with_moments(chains))
    on = F.transform(F.filter(F.arrays_zip("line_off", "along"), lambda p: F.abs(p["line_off"]) <= INLIER), lambda p: p["along"])
    own = own.withColumn("on", on).withColumn("on", F.when(F.size("on") >= 2, F.col("on")).otherwise(F.col("along")))
    at = lambda c, u: F.col(f"m{c}") + u * (F.cos("theta") if c == "x" else F.sin("theta"))
    lo, hi = F.array_min("on"), F.array_max("on")
    out = own.withColumns({"angle": F.pmod(F.degrees("theta"), F.lit(180.0)), "x1": at("x", lo), "y1": at("y", lo), "x2": at("x", hi), "y2": at("y", hi)})
    return out.select(*chains.columns, "n", "angle", F.col("line_inliers").alias("inliers"), F.col("line_rms").alias("rms"), F.col("line").alias("confidence"), "x1", "y1", "x2", "y2")


def with_circles(chains: DataFrame) -> DataFrame:
    """Chains with moments and their algebraic circle: ``cx, cy, radius, circle_inliers, circle_rms, circle``; nulls if there is none."""
    s = lambda k: F.col("s")[k]
    det = s("uu") * s("vv") - s("uv") * s("uv")
    right = (s("uuu") + s("uvv")) / 2, (s("vvv") + s("vuu")) / 2
    good = F.abs(det) > 1e-9 * (s("uu") + s("vv")) * (s("uu") + s("vv"))
    own = chains.withColumns({"ca": F.when(good, F.try_divide(right[0] * s("vv") - right[1] * s("uv"), det)), "cb": F.when(good, F.try_divide(right[1] * s("uu") - right[0] * s("uv"), det))})
    radius = F.sqrt(F.col("ca") * F.col("ca") + F.col("cb") * F.col("cb") + (s("uu") + s("vv")) / F.col("n"))
    own = own.withColumn("radius", F.when(radius > 1e-3, radius)).withColumns({"cx": F.when(F.col("radius").isNotNull(), F.col("mx") + F.col("ca")), "cy": F.when(F.col("radius").isNotNull(), F.col("my") + F.col("cb"))})
    own = own.withColumn("circle_off", F.when(F.col("radius").isNotNull(), F.transform("uv", lambda p: F.hypot(p["u"] - F.col("ca"), p["v"] - F.col("cb")) - F.col("radius"))))
    own = own.withColumns({"circle_inliers": F.when(F.col("radius").isNotNull(), share_within("circle_off")), "circle_rms": F.when(F.col("radius").isNotNull(), root_mean_square("circle_off"))})
    return own.withColumn("circle", confidence(F.col("circle_inliers"), F.col("circle_rms")))


def circle_fits(chains: DataFrame) -> DataFrame:
    """Algebraic circle of each chain that has one; collinear chains and radii of 0 have no row."""
    out = with_circles(with_moments(chains)).where("radius is not null")
    return out.select(*chains.columns, "n", "cx", "cy", "radius", F.col("circle_inliers").alias("inliers"), F.col("circle_rms").alias("rms"), F.col("circle").alias("confidence"))


def arc_spans(chains: DataFrame) -> DataFrame:
    """Start, end and span of the arc that each chain's inliers (all its points, if fewer than five) cover around its circle."""
    own = with_circles(with_moments(chains)).where("radius is not null")
    angle = lambda p: F.pmod(F.degrees(F.atan2(p["v"] - F.col("cb"), p["u"] - F.col("ca"))), F.lit(360.0))
    on = F.transform(F.filter(F.arrays_zip("uv", "circle_off"), lambda p: F.abs(p["circle_off"]) <= INLIER), lambda p: p["uv"])
    own = own.withColumn("on", on).withColumn("on", F.when(F.size("on") >= ARC_POINTS, F.col("on")).otherwise(F.col("uv")))
    own = own.withColumn("arc", largest_gap(F.transform("on", angle)))
    return own.select(*chains.columns, "cx", "cy", "radius", "arc.start", "arc.end", (360.0 - F.col("arc.gap")).alias("span"))


def ellipse_confidence(pts: pd.Series) -> pd.Series:
    """Confidence of the ellipse through each chain, null without one; chains that are null are not tried."""
    from vellum.operators.strokes import ellipse_fit, ellipse_offsets

    def one(p: object) -> float | None:
        if p is None:
            return None
        xy = np.array([(q["x"], q["y"]) for q in p], float)
        fit = ellipse_fit(xy)
        if fit is None:
            return None
        off = ellipse_offsets(xy, fit)
        return float((off <= ELLIPSE_INLIER).mean() * max(0.0, 1 - np.sqrt((off**2).mean()) / SCALE))

    return pd.Series([one(p) for p in pts], dtype="float64")


def fit_choice(chains: DataFrame, ellipses: bool = True) -> DataFrame:
    """Type and confidence of each open chain by the cascade of fits: line, arc, ellipse, the better of arc and line, polyline.

    An arc that hardly bends over its chord is a line if the line fits somewhat.  Arcs need five points, ellipses six.  Ellipses
    are fitted in Arrow batches, and only where line and arc have failed; a single point is a polyline of confidence 0.
    """
    own = with_circles(with_lines(with_moments(chains)))
    a, b = first_point(F.col("pts")), last_point(F.col("pts"))
    own = own.withColumns({"chord": F.hypot(a["x"] - b["x"], a["y"] - b["y"]), "arc": F.when(F.col("n") >= ARC_POINTS, F.coalesce("circle", F.lit(0.0))).otherwise(F.lit(0.0))})
    bulge = F.array_max(F.transform("pts", lambda p: F.abs((p["x"] - a["x"]) * (a["y"] - b["y"]) - (p["y"] - a["y"]) * (a["x"] - b["x"]))))
    own = own.withColumn("sagitta", F.when(F.col("chord") > MIN_CHORD, bulge / F.col("chord")))
    bends = (F.col("sagitta") >= MIN_BEND * F.col("chord")) & (F.col("sagitta") >= MIN_SAGITTA)
    own = own.withColumn("flat", F.coalesce((F.col("chord") > MIN_CHORD) & ~bends & (F.col("line") >= STRAIGHT_OK), F.lit(False)))
    arc = F.when(F.col("flat"), "line").otherwise("arc")
    own = own.withColumn("first", F.when(F.col("n") < 2, "polyline").when(F.col("line") >= LINE_OK, "line").when(F.col("arc") >= ARC_OK, arc))
    tried = F.pandas_udf(ellipse_confidence, "double")(F.when(F.col("first").isNull() & (F.col("n") >= ELLIPSE_POINTS), F.col("pts")))
    own = own.withColumn("ellipse", F.coalesce(tried, F.lit(0.0)) if ellipses else F.lit(0.0))
    better = F.when((F.col("n") < ARC_POINTS) | (F.col("line") > F.col("arc")), "line").otherwise(arc)
    kind = F.coalesce("first", F.when(F.col("ellipse") >= ELLIPSE_OK, "ellipse"), F.when(F.greatest("arc", "line") > BEST_OK, better), F.lit("polyline"))
    own = own.withColumn("type", kind)
    sure = F.when(F.col("n") < 2, F.lit(0.0)).when(F.col("type") == "polyline", F.lit(POLYLINE)).when(F.col("type") == "arc", F.col("arc")).when(F.col("type") == "ellipse", F.col("ellipse")).otherwise(F.col("line"))
    return own.select(*chains.columns, "n", "type", sure.alias("confidence"))


def closed_choice(chains: DataFrame) -> DataFrame:
    """Type and confidence of each closed chain: circle, else ellipse, else polygon, else polyline; those that are no circle are fitted in Arrow batches."""
    from vellum.operators.strokes import closed_fit

    own = with_circles(with_moments(chains))
    own = own.withColumn("circle", F.when(F.col("n") >= CIRCLE_POINTS, F.coalesce("circle", F.lit(0.0))).otherwise(F.lit(0.0)))

    def rest(pts: pd.Series) -> pd.DataFrame:
        found = [(None, None) if p is None else closed_fit([(q["x"], q["y"]) for q in p], circles=False) for p in pts]
        return pd.DataFrame(found, columns=["type", "confidence"])

    tried = F.pandas_udf(rest, "type string, confidence double")(F.when(F.col("circle") < CIRCLE_OK, F.col("pts")))
    own = own.withColumn("fit", tried)
    return own.select(*chains.columns, "n", F.coalesce("fit.type", F.lit("circle")).alias("type"), F.coalesce("fit.confidence", "circle").alias("confidence"))


def line_like(length: Column, straightness: Column, rms: Column, limits: tuple[float, float, float, float] = STROKE) -> Column:
    """Whether a stroke can belong to a hachure."""
    return length.between(limits[0], limits[1]) & (straightness >= limits[2]) & (rms <= limits[3])


def circular(chains: DataFrame, most: float = 80.0) -> DataFrame:
    """Closed chains with ``noise``: shorter than ``most`` and not circular.

    Circular are chains of six points or more whose mean distance to their centre is a pixel or more and spreads by less than
    0.55 of it below twelve pixels, else by less than 0.30.
    """
    own = centred(chain_features(chains)).withColumn("reach", F.transform("uv", lambda p: F.hypot(p["u"], p["v"])))
    own = own.withColumn("r", total(F.col("reach")) / F.size("reach"))
    own = own.withColumn("spread", F.sqrt(total(F.transform("reach", lambda d: (d - F.col("r")) * (d - F.col("r")))) / F.size("reach")))
    is_round = (F.size("pts") >= 6) & (F.col("r") >= 1) & (F.col("spread") < F.col("r") * F.when(F.col("r") < 12, 0.55).otherwise(0.30))
    return own.select(*chains.columns, "length", "r", "spread", is_round.alias("round"), ((F.col("length") < most) & ~is_round).alias("noise"))


# --- boxes and segments


def point_box(x: Column, y: Column, box: Callable[[str], Column]) -> Column:
    """Distance of a point to a box ``(x, y, w, h)``; 0 inside."""
    dx = F.greatest(box("x") - x, F.lit(0.0), x - box("x") - box("w"))
    dy = F.greatest(box("y") - y, F.lit(0.0), y - box("y") - box("h"))
    return F.hypot(dx, dy)


def point_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment; a segment of no length is a point."""
    n = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1), n), F.lit(0.0))))
    return F.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def meets_box(x1: Column, y1: Column, x2: Column, y2: Column, box: Callable[[str], Column]) -> Column:
    """Whether a segment and a box have a point in common: the parts of the segment between each pair of sides overlap."""

    def within(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        p, q = F.try_divide(low - a, b - a), F.try_divide(high - a, b - a)
        still = a.between(low, high)
        return F.coalesce(F.least(p, q), F.when(still, F.lit(0.0)).otherwise(F.lit(2.0))), F.coalesce(F.greatest(p, q), F.when(still, F.lit(1.0)).otherwise(F.lit(-1.0)))

    ax, bx = within(x1, x2, box("x"), box("x") + box("w"))
    ay, by_ = within(y1, y2, box("y"), box("y") + box("h"))
    return F.greatest(ax, ay, F.lit(0.0)) <= F.least(bx, by_, F.lit(1.0))


def segment_box(x1: Column, y1: Column, x2: Column, y2: Column, box: Callable[[str], Column]) -> Column:
    """Distance of a segment to a box: 0 if they meet, else the least of the ends to the box and the corners to the segment."""
    corners = [(box("x") + i * box("w"), box("y") + j * box("h")) for i in (0, 1) for j in (0, 1)]
    apart = F.least(point_box(x1, y1, box), point_box(x2, y2, box), *[point_segment(x, y, x1, y1, x2, y2) for x, y in corners])
    return F.when(meets_box(x1, y1, x2, y2, box), F.lit(0.0)).otherwise(apart)


def overlap(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Common area of two boxes."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a(p) + a(s), b(p) + b(s)) - F.greatest(a(p), b(p)))
    return side("x", "w") * side("y", "h")


# --- distance joins


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], cutoff: float) -> DataFrame:
    """All pairs of points ``(x, y)`` of a group within ``cutoff`` of each other, over cells of that size; other columns must differ."""
    cell = lambda c: F.floor(F.col(c) / F.lit(cutoff)).cast("bigint")
    a = left.withColumn("cx", cell("x")).withColumn("cy", cell("y")).withColumnsRenamed({"x": "ax", "y": "ay"})
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.withColumn("_s", F.explode(moves)).withColumn("cx", cell("x") + F.col("_s.i")).withColumn("cy", cell("y") + F.col("_s.j")).drop("_s").withColumnsRenamed({"x": "bx", "y": "by_"})
    gap = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by_"))
    return a.join(b, [*by, "cx", "cy"]).withColumn("distance", gap).where(F.col("distance") <= cutoff).drop("cx", "cy")


def nearest_distances(a: DataFrame, b: DataFrame, by: list[str], reach: float = 64.0) -> DataFrame:
    """``(by, distance)`` of every point of ``a`` to its nearest of ``b`` in the group, by widening cells: points without a partner within
    ``reach`` look again at four times the reach.  Groups in which either side has no point have no row."""
    both = a.select(*by).distinct().join(b.select(*by).distinct(), by, "left_semi")
    left = written(a.join(both, by, "left_semi").select(*by, "x", "y").withColumn("one", F.monotonically_increasing_id()), "nearest")
    right = written(b.join(both, by, "left_semi").select(*by, "x", "y", F.lit(0).alias("other")), "nearest")
    found = None
    while left.take(1):
        part = written(nearest(left, right, by, "one", "other", reach).select(*by, "one", "distance"), "nearest")
        found = part if found is None else found.unionByName(part)
        left = written(left.join(part.select("one"), "one", "left_anti"), "nearest")
        reach *= 4
    return left.select(*by, F.lit(0.0).alias("distance")) if found is None else found.select(*by, "distance")


def chamfer(a: DataFrame, b: DataFrame, by: list[str], reach: float = 64.0) -> DataFrame:
    """Mean nearest distance from ``a`` to ``b`` in each group."""
    return nearest_distances(a, b, by, reach).groupBy(*by).agg(F.avg("distance").alias("mean"), F.count("*").alias("n"))


def chamfer_both(a: DataFrame, b: DataFrame, by: list[str], reach: float = 64.0) -> DataFrame:
    """Mean nearest distance ``there`` and ``back``, their mean ``chamfer`` and the 95th percentile over both, in one run of the join."""
    way = lambda df, n: df.select(*by, "x", "y", F.lit(n).alias("way"))
    d = nearest_distances(way(a, 0).unionByName(way(b, 1)), way(b, 0).unionByName(way(a, 1)), [*by, "way"], reach)
    mean = lambda n: F.avg(F.when(F.col("way") == n, F.col("distance")))
    out = d.groupBy(*by).agg(mean(0).alias("there"), mean(1).alias("back"), F.percentile("distance", F.lit(0.95)).alias("p95"))
    return out.withColumn("chamfer", (F.col("there") + F.col("back")) / 2)


def crossing_numbers(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Crossing number of every foreground pixel: half the changes around its eight neighbours.

    Every pixel reports itself to its neighbours; one aggregation with map-side combine, no self join.
    """
    ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    to = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(k).alias("k")) for k, (i, j) in enumerate(ring)], F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(8).alias("k")))
    told = pixels.select(*by, "x", "y").distinct().select(*by, "x", "y", F.explode(to).alias("t")).select(*by, (F.col("x") + F.col("t.i")).alias("x"), (F.col("y") + F.col("t.j")).alias("y"), F.col("t.k").alias("k"))
    bits = told.groupBy(*by, "x", "y").agg(F.sum(F.expr("cast(1 << k as int)")).alias("bits")).where("bits >= 256")
    bit = lambda k: F.getbit("bits", F.lit(k % 8)).cast("int")
    changes = sum((F.abs(bit(k) - bit(k + 1)) for k in range(8)), F.lit(0))
    return bits.select(*by, "x", "y", F.expr("bit_count(bits & 255)").alias("n_neighbours"), (changes / 2).cast("int").alias("crossing"))
