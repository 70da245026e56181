"""Labels of drawings as tables: overlapping boxes, leaders, clusters of text boxes, labels without leaders, labels attached to primitives.

Boxes have ``x, y, w, h``; lines have ``x1, y1, x2, y2, length, angle``.  What can be near each other meets over grid cells within its
group, so no group is paired with itself whole.

Defined results: boxes and lines with a null coordinate meet nothing; boxes of no area cover nothing; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.keys import plain_patent
from vellum.operators import geometry as geo
from vellum.operators import nested
from vellum.operators.relational import grouped_within

CELL = 256.0


def cells_between(low: Column, high: Column, size: float) -> Column:
    """Numbers of the cells that an interval touches."""
    return F.sequence(F.floor(low / size).cast("bigint"), F.floor(high / size).cast("bigint"))


def boxed(df: DataFrame, margin: float = 0.0, size: float = CELL) -> DataFrame:
    """Boxes once per cell ``(cx, cy)`` that they, widened by ``margin``, touch."""
    span = lambda a, s: cells_between(F.col(a) - margin, F.col(a) + F.col(s) + margin, size)
    good = df.where("x is not null and y is not null and w >= 0 and h >= 0")
    return good.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))


def crossed(df: DataFrame, size: float = CELL) -> DataFrame:
    """Lines once per cell that they pass through: column by column, the rows between the heights at its sides."""
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    good = df.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    cols = good.withColumn("cx", F.explode(cells_between(F.least(x1, x2), F.greatest(x1, x2), size)))
    lo, hi = F.greatest(F.least(x1, x2), F.col("cx") * size), F.least(F.greatest(x1, x2), (F.col("cx") + 1) * size)
    at = lambda x: F.coalesce(y1 + F.try_divide(x - x1, x2 - x1) * (y2 - y1), y1)
    low = F.when(x1 == x2, F.least(y1, y2)).otherwise(F.least(at(lo), at(hi))) - 1e-6
    high = F.when(x1 == x2, F.greatest(y1, y2)).otherwise(F.greatest(at(lo), at(hi))) + 1e-6
    return cols.withColumn("cy", F.explode(cells_between(low, high, size)))


def covering(boxes: DataFrame, others: DataFrame, by: list[str], share: float, box_id: str = "pos") -> DataFrame:
    """``(by, id, other)``: boxes of which another box of the group covers more than ``share``; a box does not cover itself."""
    o = boxed(others).select(*by, "cx", "cy", F.col(box_id).alias("other"), *[F.col(c).alias(f"o{c}") for c in "xywh"])
    met = boxed(boxes).join(o, [*by, "cx", "cy"]).where(F.col(box_id) != F.col("other"))
    over = geo.overlap(lambda c: F.col(c), lambda c: F.col(f"o{c}")) > share * F.col("w") * F.col("h")
    return met.where(over).select(*by, box_id, "other").distinct()


def similar(a: Column, b: Column, pixels: float, degrees: float) -> Column:
    """Whether two segments have nearly the same angle and, in one order or the other, the same ends."""
    apart = lambda p, q, r, s: F.greatest(F.hypot(a[f"x{p}"] - b[f"x{q}"], a[f"y{p}"] - b[f"y{q}"]), F.hypot(a[f"x{r}"] - b[f"x{s}"], a[f"y{r}"] - b[f"y{s}"]))
    return (geo.angle_delta(a["angle"], b["angle"]) <= degrees) & (F.least(apart(1, 1, 2, 2), apart(1, 2, 2, 1)) <= pixels)


def leaders(boxes: DataFrame, lines: DataFrame, by: list[str], label: str, line: str, end: float, side: float, weight: float, pixels: float, degrees: float) -> DataFrame:
    """The best line of each label and the best that is unlike it: ``(by, label, line, place, match, dist)``.

    A line is a candidate if an end is within ``end`` of the box or, failing that, any part within ``side``; the score is that
    distance plus ``weight`` times the length.
    """
    reach = max(end, side)
    size = max(CELL, 2 * reach)
    b = boxed(boxes, reach, size).select(*by, label, "cx", "cy", *[F.col(c).alias(f"b{c}") for c in "xywh"])
    met = crossed(lines, size).select(*by, line, "cx", "cy", "x1", "y1", "x2", "y2", "length", "angle").join(b, [*by, "cx", "cy"]).drop("cx", "cy").distinct()
    box = lambda c: F.col(f"b{c}")
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    far = met.withColumns({"d_end": F.least(geo.point_box(x1, y1, box), geo.point_box(x2, y2, box)), "d_side": geo.segment_box(x1, y1, x2, y2, box)})
    by_end = F.col("d_end") <= end
    cand = far.where(by_end | (F.col("d_side") <= side)).withColumns({"dist": F.when(by_end, F.col("d_end")).otherwise(F.col("d_side")), "match": F.when(by_end, "endpoint").otherwise("segment")})
    w = Window.partitionBy(*by, label).orderBy(F.round(F.col("dist") + weight * F.col("length"), 6), line)
    own = cand.withColumn("seg", F.struct("x1", "y1", "x2", "y2", "angle")).withColumns({"rank": F.row_number().over(w), "best": F.first("seg").over(w)})
    own = own.withColumn("alike", similar(F.col("seg"), F.col("best"), pixels, degrees))
    own = own.withColumn("r", F.row_number().over(Window.partitionBy(*by, label, "alike").orderBy("rank")))
    return own.where((F.col("rank") == 1) | (~F.col("alike") & (F.col("r") == 1))).withColumn("place", F.when(F.col("rank") == 1, 1).otherwise(2)).select(*by, label, line, "place", "match", "dist")


def text_clusters(boxes: DataFrame, by: list[str], box_id: str, gap: float, off: float, part: float, reach: float) -> DataFrame:
    """Boxes side by side on one line, joined over any number of steps: ``(by, root, n, x, y, w, h, ink, density)`` of each cluster.

    Two boxes join if the gap between them is at most ``gap``, their middles are within ``reach`` of each other sideways, and they
    are on one line: middles within ``off`` (or ``part`` of the larger height), or heights that overlap by a third.  Boxes need ``area``.
    """
    size = max(CELL, gap)
    grown = boxes.withColumn("k", F.col(box_id))
    # boxes of one line overlap once their heights are widened by what may lie between middles, and their widths by the gap
    tall = F.greatest(F.lit(off), part * F.col("h")) + gap
    span = lambda a, s, m: cells_between(F.col(a) - m, F.col(a) + F.col(s) + m, size)
    good = grown.where("x is not null and y is not null and w >= 0 and h >= 0")
    spread = good.withColumn("cx", F.explode(span("x", "w", F.lit(gap)))).withColumn("cy", F.explode(span("y", "h", tall)))
    a = spread.select(*by, box_id, "cx", "cy", *"xywh")
    b = a.select(*by, F.col(box_id).alias("other"), "cx", "cy", *[F.col(c).alias(f"o{c}") for c in "xywh"])
    c = F.col
    apart = F.greatest(F.lit(0.0), c("ox") - c("x") - c("w"), c("x") - c("ox") - c("ow"))
    middle = F.abs(c("y") + c("h") / 2 - c("oy") - c("oh") / 2)
    shared = F.greatest(F.lit(0.0), F.least(c("y") + c("h"), c("oy") + c("oh")) - F.greatest(c("y"), c("oy"))) / F.greatest(F.lit(1.0), F.least("h", "oh"))
    one_line = (middle <= F.greatest(F.lit(off), part * F.greatest("h", "oh"))) | (shared >= 0.35)
    met = a.join(b, [*by, "cx", "cy"]).where((c(box_id) < c("other")) & (apart <= gap) & (F.abs(c("x") + c("w") / 2 - c("ox") - c("ow") / 2) < reach) & one_line)
    roots = grouped_within(met.select(*by, box_id, "other").distinct(), by[0], box_id, "other")
    own = boxes.join(roots, [*by, box_id], "left").withColumn("root", F.coalesce("root", box_id))
    out = own.groupBy(*by, "root").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(c("x") + c("w")) - F.min("x")).alias("w"), (F.max(c("y") + c("h")) - F.min("y")).alias("h"), F.sum("area").alias("ink"))
    return out.withColumn("density", c("ink") / F.greatest(F.lit(1.0), c("w") * c("h")))


def in_margin(share: float) -> Column:
    """Whether a box's middle lies in the outer ``share`` of a page of ``width`` and ``height``."""
    middle = lambda a, s: F.col(a) + F.col(s) / 2
    x, y, w, h = middle("x", "w"), middle("y", "h"), F.col("width"), F.col("height")
    return (x <= share * w) | (x >= w - share * w) | (y <= share * h) | (y >= h - share * h)


def looks_unleadered() -> Column:
    """Whether a cluster is a label that has no leader.  Fixed values: limits of components, box, ink and density; stricter for one component."""
    area = F.col("w") * F.col("h")
    shape = F.col("w").between(4, 150) & F.col("h").between(7, 95) & (area <= 6500) & (F.col("ink") <= 2200) & F.col("density").between(0.05, 0.78)
    single = (F.col("density") >= 0.18) & (area <= 3000) & (F.col("ink") <= 1400) & in_margin(0.24)
    return F.col("n").between(1, 6) & shape & ((F.col("n") > 1) | single)


FILE = "struct<sketch_id:string,primitives:array<struct<edge_id:string>>,_bad:string>"


def attached(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Live primitive files with the numbers of labels and leaders that the last document of their sketch brings along.

    Leaders marked as not removed stay in the drawing and are dropped; a file whose sketch has no document has no labels.
    """
    doc = F.from_json("body", FILE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    own = files.where("kind = 'primitives' and deleted_at is null and trim(body) <> ''").select("file_no", "patent_id", doc.alias("d")).where("d is not null and d._bad is null")
    own = own.select("file_no", "patent_id", F.col("d.sketch_id").alias("sketch_id"), F.coalesce(F.size("d.primitives"), F.lit(0)).alias("n_primitives"))
    counts = nested.label_counts(docs)
    last = docs.select("doc_no", plain_patent(F.col("patent_id")).alias("patent_id"), "sketch_id").join(counts, "doc_no")
    last = last.groupBy("patent_id", "sketch_id").agg(F.max(F.struct("doc_no", "n_annotations", "n_leaders")).alias("m"))
    joined = own.join(last, ["patent_id", "sketch_id"], "left")
    return joined.select("file_no", "n_primitives", F.coalesce("m.n_annotations", F.lit(0)).cast("bigint").alias("n_annotations"), F.coalesce("m.n_leaders", F.lit(0)).cast("bigint").alias("n_leaders"))
