"""Queries over lines, circles and labels of the primitive documents, and over the graph documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import geometry as geo
from vellum.operators import graphs, labelling, nested
from vellum.operators import relational as rel
from vellum.operators.components import components
from vellum.plans.chain_queries import points, rounded
from vellum.plans.data_queries import P1_RECORDS
from vellum.plans.registry import registry
from vellum.session import table, written

QUERIES, ORACLES, query = registry()
#: The strokes of the documents are about ten times as long as those of a raster, for which the limits below are made.
UNIT = 10.0
#: Parallel strokes (degrees, pixels, strokes, total length, largest share removed).
ANGLE, NEAR, GROUP, TOTAL, MOST = 12.0, 95.0 * UNIT, 4, 35.0 * UNIT, 0.75
#: Leaders (pixels from an end and from the stroke to the label, weight of length, leaders of a label, likeness in pixels and degrees).
LEADER_END, LEADER_SIDE, LEADER_WEIGHT, ALIKE, ALIKE_ANGLE = 18.0 * UNIT, 12.0 * UNIT, 0.015, 8.0, 8.0
#: Edges of the graph documents join random nodes, so a spur of six pixels is one of 900 there.
SPUR = 900.0

SQL_LINES = f"""WITH {P1_RECORDS},
ln AS (SELECT doc_no, pos, item->>'style' AS style, (item->>'$.p1[0]')::DOUBLE AS x1, (item->>'$.p1[1]')::DOUBLE AS y1, (item->>'$.p2[0]')::DOUBLE AS x2, (item->>'$.p2[1]')::DOUBLE AS y2 FROM records WHERE child = 'primitives' AND item->>'type' = 'line'),
lines AS (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, sqrt((x1-x2)*(x1-x2) + (y1-y2)*(y1-y2)) AS length, (degrees(atan2(y2 - y1, x2 - x1)) + 360) % 180 AS angle FROM ln)"""
SQL_BOXES = f"""WITH {P1_RECORDS},
bx AS (SELECT doc_no, pos, item->>'kind' AS kind, (item->>'$.bbox[0]')::DOUBLE AS x, (item->>'$.bbox[1]')::DOUBLE AS y, (item->>'$.bbox[2]')::DOUBLE AS w, (item->>'$.bbox[3]')::DOUBLE AS h FROM records WHERE child = 'annotations')"""


def records(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Records of the wanted kinds with typed columns; one parse."""
    return nested.shred(table(spark, d, "primitive_docs"), kinds=kinds)


def with_measures(t: DataFrame) -> DataFrame:
    """Lines ``(x1, y1, x2, y2)`` with their middle, length and angle."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return t.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2, "length": F.hypot(dx, dy), "angle": F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))})


def lines_of(t: DataFrame) -> DataFrame:
    t = nested.typed_table(t, "primitives", "line")
    return with_measures(t.select("doc_no", "pos", "style", F.col("p1_0").alias("x1"), F.col("p1_1").alias("y1"), F.col("p2_0").alias("x2"), F.col("p2_1").alias("y2")))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(records(spark, d, "primitives"))


def boxes_of(rows: DataFrame) -> DataFrame:
    return rows.where("child = 'annotations'").select("doc_no", "pos", "kind", *[F.col(f"bbox_{i}").alias(c) for i, c in enumerate("xywh")])


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes_of(records(spark, d, "annotations"))


# --- labels


@query(f"{SQL_BOXES} SELECT doc_no, count(*) AS n_boxes, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, sum(w * h) AS area FROM bx GROUP BY doc_no")
def box_unions(spark, d):
    """Union of each document's annotation boxes."""
    edge = lambda a, s: F.max(F.col(a) + F.col(s)) - F.min(a)
    return boxes(spark, d).groupBy("doc_no").agg(F.count("*").alias("n_boxes"), F.min("x").alias("x"), F.min("y").alias("y"), edge("x", "w").alias("w"), edge("y", "h").alias("h"), F.sum(F.col("w") * F.col("h")).alias("area"))


@query(f"""{SQL_BOXES}
SELECT doc_no, pos::INT AS pos FROM bx a WHERE kind = 'figure' AND NOT EXISTS (SELECT 1 FROM bx b WHERE b.kind = 'label' AND a.doc_no = b.doc_no
  AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) > 0.35 * a.w * a.h)""")
def clear_figures(spark, d):
    """Figure boxes that no label of the document covers by more than a third; boxes meet over cells of 256 pixels."""
    b = written(boxes(spark, d), "boxes")
    covered = labelling.covering(b.where("kind = 'figure'"), b.where("kind = 'label'"), ["doc_no"], 0.35).select("doc_no", "pos")
    return b.where("kind = 'figure'").select("doc_no", "pos").join(covered, ["doc_no", "pos"], "left_anti")


@query(f"""{SQL_BOXES},
o AS (SELECT a.doc_no, a.pos, b.pos AS other FROM bx a JOIN bx b ON a.doc_no = b.doc_no AND b.pos < a.pos
  AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) > 0.65 * a.w * a.h)
SELECT doc_no, pos::INT AS pos FROM bx WHERE (doc_no, pos) NOT IN (SELECT (doc_no, pos) FROM o)""")
def distinct_boxes(spark, d):
    """Boxes that no earlier box of the document covers by more than 0.65 of their area."""
    b = written(boxes(spark, d), "boxes")
    return b.select("doc_no", "pos").join(labelling.covering(b, b, ["doc_no"], 0.65).where("other < pos").select("doc_no", "pos"), ["doc_no", "pos"], "left_anti")


PB = "sqrt(greatest(b.x - {0}, 0, {0} - b.x - b.w) ** 2 + greatest(b.y - {1}, 0, {1} - b.y - b.h) ** 2)".format
PS = "sqrt(({0} - x1 - {2} * (x2 - x1)) ** 2 + ({1} - y1 - {2} * (y2 - y1)) ** 2)".format


def sql_corner(x: str, y: str) -> str:
    t = f"greatest(0, least(1, coalesce((({x}) - x1) * (x2 - x1) + (({y}) - y1) * (y2 - y1), 0) / nullif((x2 - x1) ** 2 + (y2 - y1) ** 2, 0)))"
    return PS(f"({x})", f"({y})", f"coalesce({t}, 0)")


def sql_within(a: str, b: str, low: str, high: str) -> str:
    return f"""CASE WHEN {a} = {b} THEN CASE WHEN {a} BETWEEN {low} AND {high} THEN [0.0, 1.0] ELSE [2.0, -1.0] END
    ELSE [least(({low} - {a}) / ({b} - {a}), ({high} - {a}) / ({b} - {a})), greatest(({low} - {a}) / ({b} - {a}), ({high} - {a}) / ({b} - {a}))] END"""


SQL_LEADERS = f"""{SQL_LINES}, {SQL_BOXES[SQL_BOXES.index('bx AS'):]},
near AS (SELECT l.doc_no, l.pos, b.pos AS label_pos, l.length, l.angle, x1, y1, x2, y2, least({PB('x1', 'y1')}, {PB('x2', 'y2')}) AS d_end,
  {sql_within('x1', 'x2', 'b.x', '(b.x + b.w)')} AS tx, {sql_within('y1', 'y2', 'b.y', '(b.y + b.h)')} AS ty,
  least({sql_corner('b.x', 'b.y')}, {sql_corner('b.x + b.w', 'b.y')}, {sql_corner('b.x', 'b.y + b.h')}, {sql_corner('b.x + b.w', 'b.y + b.h')}) AS d_corner
  FROM lines l JOIN bx b USING (doc_no)),
sided AS (SELECT *, CASE WHEN greatest(tx[1], ty[1], 0.0) <= least(tx[2], ty[2], 1.0) THEN 0.0 ELSE least(d_end, d_corner) END AS d_side FROM near),
cand AS (SELECT *, CASE WHEN d_end <= {LEADER_END} THEN d_end ELSE d_side END AS dist, CASE WHEN d_end <= {LEADER_END} THEN 'endpoint' ELSE 'segment' END AS match FROM sided WHERE d_end <= {LEADER_END} OR d_side <= {LEADER_SIDE}),
ranked AS (SELECT *, row_number() OVER w AS place, first(x1) OVER w AS fx1, first(y1) OVER w AS fy1, first(x2) OVER w AS fx2, first(y2) OVER w AS fy2, first(angle) OVER w AS fa FROM cand
  WINDOW w AS (PARTITION BY doc_no, label_pos ORDER BY round(dist + {LEADER_WEIGHT} * length, 6), pos)),
like_first AS (SELECT *, least(abs(angle - fa) % 180, 180 - abs(angle - fa) % 180) <= {ALIKE_ANGLE} AND least(greatest(sqrt((x1 - fx1) ** 2 + (y1 - fy1) ** 2), sqrt((x2 - fx2) ** 2 + (y2 - fy2) ** 2)), greatest(sqrt((x1 - fx2) ** 2 + (y1 - fy2) ** 2), sqrt((x2 - fx1) ** 2 + (y2 - fy1) ** 2))) <= {ALIKE} AS alike FROM ranked),
second AS (SELECT *, row_number() OVER (PARTITION BY doc_no, label_pos, alike ORDER BY place) AS r FROM like_first)"""


@query(f"{SQL_LEADERS} SELECT doc_no, label_pos::INT AS label_pos, pos::INT AS pos, CASE WHEN place = 1 THEN 1 ELSE 2 END::INT AS place, match, round(dist, 4) AS dist FROM second WHERE place = 1 OR (NOT alike AND r = 1)")
def label_leaders(spark, d):
    """The best two strokes that end near each label or pass by it, the second unlike the first."""
    rows = written(records(spark, d, "primitives", "annotations"), "leader-records")
    found = labelling.leaders(boxes_of(rows).withColumnRenamed("pos", "label_pos"), lines_of(rows), ["doc_no"], "label_pos", "pos", LEADER_END, LEADER_SIDE, LEADER_WEIGHT, ALIKE, ALIKE_ANGLE)
    return rounded(found.select("doc_no", "label_pos", "pos", "place", "match", "dist"), "dist")


GAP, LINE_OFF, LINE_PART, SPAN_X, FILL = 22.0 * UNIT, 18.0 * UNIT, 0.75, 220.0 * UNIT, 0.4
SQL_CLUSTERS = f"""WITH RECURSIVE {SQL_BOXES[5:]},
pr AS (SELECT a.doc_no, a.pos AS p, b.pos AS q FROM bx a JOIN bx b ON a.doc_no = b.doc_no AND a.pos <> b.pos
  WHERE greatest(0, b.x - a.x - a.w, a.x - b.x - b.w) <= {GAP} AND abs(a.x + a.w / 2 - b.x - b.w / 2) < {SPAN_X}
  AND (abs(a.y + a.h / 2 - b.y - b.h / 2) <= greatest({LINE_OFF}, {LINE_PART} * greatest(a.h, b.h)) OR greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / greatest(1, least(a.h, b.h)) >= 0.35)),
reach AS (SELECT doc_no, p, q FROM pr UNION SELECT r.doc_no, r.p, pr.q FROM reach r JOIN pr ON r.doc_no = pr.doc_no AND r.q = pr.p),
roots AS (SELECT doc_no, p AS pos, least(p, min(q)) AS root FROM reach GROUP BY doc_no, p),
cl AS (SELECT doc_no, coalesce(root, pos) AS root, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, sum({FILL} * w * h) AS ink FROM bx LEFT JOIN roots USING (doc_no, pos) GROUP BY ALL),
clusters AS (SELECT *, ink / greatest(1, w * h) AS density FROM cl)"""


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of annotation boxes that stand on one line; a box counts as two fifths full of ink."""
    b = written(boxes(spark, d).withColumn("area", FILL * F.col("w") * F.col("h")), "label-boxes")
    return labelling.text_clusters(b, ["doc_no"], "pos", GAP, LINE_OFF, LINE_PART, SPAN_X)


@query(f"{SQL_CLUSTERS} SELECT doc_no, root::INT AS root, n, round(x, 3) AS x, round(y, 3) AS y, round(w, 3) AS w, round(h, 3) AS h, round(density, 6) AS density FROM clusters WHERE n <= 6 AND density BETWEEN 0.06 AND 0.80")
def text_clusters(spark, d):
    """Groups of boxes side by side on one line with their union; crowded, empty and full ones are no labels."""
    own = clustered(spark, d).where("n <= 6 and density between 0.06 and 0.80")
    return rounded(rounded(own.select("doc_no", "root", "n", "x", "y", "w", "h", "density"), "x", "y", "w", "h", to=3), "density", to=6)


SQL_SIZES = "sizes AS (SELECT doc_no, (body->>'$.image_size[0]')::DOUBLE AS width, (body->>'$.image_size[1]')::DOUBLE AS height FROM good)"


@query(f"""{SQL_CLUSTERS}, {SQL_SIZES}
SELECT doc_no, root::INT AS root FROM clusters JOIN sizes USING (doc_no) WHERE n BETWEEN 1 AND 6 AND w BETWEEN 4 AND 150 AND h BETWEEN 7 AND 95 AND w * h <= 6500 AND ink <= 2200 AND density BETWEEN 0.05 AND 0.78
  AND (n > 1 OR (density >= 0.18 AND w * h <= 3000 AND ink <= 1400 AND (x + w / 2 <= 0.24 * width OR x + w / 2 >= width - 0.24 * width OR y + h / 2 <= 0.24 * height OR y + h / 2 >= height - 0.24 * height)))""")
def unleadered_labels(spark, d):
    """Clusters that look like labels without a leader: limits of size and ink, and for a single component a place near the margin."""
    sizes = nested.headers(table(spark, d, "primitive_docs")).select("doc_no", "width", "height")
    return clustered(spark, d).join(sizes, "doc_no").where(labelling.looks_unleadered()).select("doc_no", "root")


@query(f"""WITH {P1_RECORDS}, files AS (SELECT file_no, patent_id, body->>'sketch_id' AS sketch_id, json_array_length(body->'primitives') AS n_primitives FROM artifact_files WHERE kind = 'primitives' AND deleted_at IS NULL AND json_valid(body) AND json_type(body) = 'OBJECT'),
keyed AS (SELECT doc_no, left(upper(regexp_replace(patent_id, '[^A-Za-z0-9]', '', 'g')), 9) AS patent_id, sketch_id FROM primitive_docs),
last AS (SELECT k.patent_id, k.sketch_id, max(k.doc_no) AS doc_no FROM keyed k JOIN good USING (doc_no) GROUP BY ALL),
a AS (SELECT doc_no, count(*) AS n FROM records WHERE child = 'annotations' GROUP BY doc_no), l AS (SELECT doc_no, count(*) AS n FROM records WHERE child = 'leader_lines' AND coalesce(item->>'removed', 'true') <> 'false' GROUP BY doc_no)
SELECT file_no, n_primitives::INT AS n_primitives, coalesce(a.n, 0) AS n_annotations, coalesce(l.n, 0) AS n_leaders FROM files LEFT JOIN last USING (patent_id, sketch_id) LEFT JOIN a USING (doc_no) LEFT JOIN l USING (doc_no)""")
def attached_references(spark, d):
    """Primitive files with the labels of their sketch's last document attached; leaders that were not removed are dropped."""
    return labelling.attached(table(spark, d, "artifact_files"), table(spark, d, "primitive_docs"))


# --- parallel strokes


def strokes_of(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a hachure could be made of."""
    return lines(spark, d).where(F.col("length").between(geo.STROKE[0] * UNIT, geo.STROKE[1] * UNIT))


def parallels(t: DataFrame) -> DataFrame:
    """Pairs of strokes of a document, nearly parallel and near each other."""
    a = t.select("doc_no", "pos", "x", "y", "angle")
    pairs = geo.near_pairs(a, a.withColumnsRenamed({"pos": "other", "angle": "other_angle"}), ["doc_no"], NEAR).where("pos < other")
    return pairs.where(geo.angle_delta(F.col("angle"), F.col("other_angle")) <= ANGLE).select("doc_no", "pos", "other")


SQL_PARALLEL = f"""strokes AS (SELECT * FROM lines WHERE length BETWEEN {geo.STROKE[0] * UNIT} AND {geo.STROKE[1] * UNIT}),
pr AS (SELECT a.doc_no, a.pos, b.pos AS other FROM strokes a JOIN strokes b ON a.doc_no = b.doc_no AND a.pos < b.pos
  WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= {NEAR} AND least(abs(a.angle - b.angle) % 180, 180 - abs(a.angle - b.angle) % 180) <= {ANGLE})"""
SQL_GROUPS = f"""WITH RECURSIVE {(SQL_LINES + ', ' + SQL_PARALLEL)[5:]},
both_ways AS (SELECT doc_no, pos AS a, other AS b FROM pr UNION SELECT doc_no, other, pos FROM pr),
reach AS (SELECT doc_no, a, b FROM both_ways UNION SELECT r.doc_no, r.a, o.b FROM reach r JOIN both_ways o ON r.doc_no = o.doc_no AND r.b = o.a),
roots AS (SELECT doc_no, a AS pos, least(a, min(b)) AS root FROM reach GROUP BY doc_no, a),
big AS (SELECT doc_no, root, count(*) AS n, sum(length) AS total FROM roots JOIN lines USING (doc_no, pos) GROUP BY doc_no, root)"""


@query(f"{SQL_LINES}, {SQL_PARALLEL} SELECT doc_no, pos::INT AS pos, other::INT AS other FROM pr")
def parallel_strokes(spark, d):
    """Band join of strokes."""
    return parallels(strokes_of(spark, d))


def grouped(t: DataFrame) -> DataFrame:
    """Strokes with the root of their group; strokes without a partner have no row."""
    return rel.grouped_within(parallels(t), "doc_no", "pos", "other").join(t.select("doc_no", "pos", "length"), ["doc_no", "pos"])


@query(f"{SQL_GROUPS} SELECT doc_no, root::INT AS root, n AS n_strokes, round(total, 4) AS total FROM big")
def parallel_groups(spark, d):
    """Groups of parallel strokes (connected pairs) with size and total length."""
    own = grouped(written(strokes_of(spark, d), "strokes"))
    return rounded(own.groupBy("doc_no", "root").agg(F.count("*").alias("n_strokes"), F.sum("length").alias("total")), "total")


@query(f"""{SQL_GROUPS},
cut AS (SELECT doc_no, sum(n) AS n FROM big WHERE n >= {GROUP} AND total >= {TOTAL} GROUP BY doc_no),
kept AS (SELECT l.doc_no, l.length, r.root IS NOT NULL AS hachure FROM lines l LEFT JOIN (SELECT roots.* FROM roots JOIN big USING (doc_no, root) WHERE n >= {GROUP} AND total >= {TOTAL}) r USING (doc_no, pos))
SELECT doc_no, count(*) AS n_lines, count(*) FILTER (hachure) AS n_hachures, count(*) FILTER (hachure) / count(*) <= {MOST} AS removed,
  count(*) FILTER (hachure) >= {GROUP} AND count(*) FILTER (hachure) / count(*) <= {MOST} AS prunes, count(*) FILTER (NOT hachure AND length < {6 * UNIT}) AS n_crumbs FROM kept GROUP BY doc_no""")
def hachure_layers(spark, d):
    """Lines of each document that go to the hachure layer: strokes in groups of four or more of enough length; whether the guard lets them, and the
    crumbs that are pruned once so many are gone."""
    all_lines = written(lines(spark, d).select("doc_no", "pos", "x", "y", "angle", "length"), "lines")
    own = grouped(all_lines.where(F.col("length").between(geo.STROKE[0] * UNIT, geo.STROKE[1] * UNIT)))
    w = Window.partitionBy("doc_no", "root")
    chosen = own.withColumns({"n": F.count("*").over(w), "total": F.sum("length").over(w)}).where((F.col("n") >= GROUP) & (F.col("total") >= TOTAL)).select("doc_no", "pos", F.lit(True).alias("hachure"))
    rows = all_lines.join(chosen, ["doc_no", "pos"], "left").withColumn("hachure", F.coalesce("hachure", F.lit(False)))
    n, m = F.count_if("hachure"), F.count("*")
    return rows.groupBy("doc_no").agg(m.alias("n_lines"), n.alias("n_hachures"), (n / m <= MOST).alias("removed"), ((n >= GROUP) & (n / m <= MOST)).alias("prunes"), F.count_if(~F.col("hachure") & (F.col("length") < 6 * UNIT)).alias("n_crumbs"))


# --- centres and confidences

SQL_CENTRES = f"""WITH {P1_RECORDS},
cc AS (SELECT doc_no, pos AS circle_pos, (item->>'$.center[0]')::DOUBLE AS x, (item->>'$.center[1]')::DOUBLE AS y FROM records WHERE child = 'primitives' AND item->>'type' IN ('circle')),
pp AS (SELECT doc_no, pos AS arc_pos, (item->>'$.center[0]')::DOUBLE AS x, (item->>'$.center[1]')::DOUBLE AS y FROM records WHERE child = 'primitives' AND item->>'type' = 'arc'),
nn AS (SELECT a.doc_no, arc_pos, circle_pos, sqrt((a.x-c.x)**2 + (a.y-c.y)**2) AS distance FROM pp a JOIN cc c USING (doc_no) QUALIFY row_number() OVER (PARTITION BY a.doc_no, arc_pos ORDER BY distance, circle_pos) = 1)"""


def centres(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = written(records(spark, d, "primitives").where("variant in ('circle', 'arc')").select("doc_no", "variant", "pos", F.col("center_0").alias("x"), F.col("center_1").alias("y")), "centres")
    at = lambda v, name: s.where(F.col("variant") == v).select("doc_no", F.col("pos").alias(name), "x", "y")
    return at("arc", "arc_pos"), at("circle", "circle_pos")


def centre_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rel.nearest(*centres(spark, d), ["doc_no"], "arc_pos", "circle_pos", 300.0)


@query(f"{SQL_CENTRES} SELECT doc_no, arc_pos::INT AS arc_pos, circle_pos::INT AS circle_pos, round(distance, 4) AS distance FROM nn WHERE distance <= 300")
def nearest_centres(spark, d):
    """The circle nearest to each arc within a cutoff."""
    return rounded(centre_pairs(spark, d), "distance")


@query(f"{SQL_CENTRES} SELECT doc_no, count(DISTINCT circle_pos) AS tp FROM nn WHERE distance <= 300 GROUP BY doc_no")
def matched_centres(spark, d):
    """True positives of matching arcs to circles one to one, where only the nearest counts."""
    return rel.matched(centre_pairs(spark, d), ["doc_no"], "circle_pos")


@query(f"{SQL_CENTRES} SELECT doc_no, arc_pos::INT AS arc_pos FROM pp WHERE (doc_no, arc_pos) NOT IN (SELECT (doc_no, arc_pos) FROM nn WHERE distance <= 300)")
def far_arcs(spark, d):
    """Arcs that no circle's centre is near: a distance anti join over cells."""
    arcs, circles = centres(spark, d)
    near = geo.near_pairs(arcs, circles, ["doc_no"], 300.0).select("doc_no", "arc_pos")
    return arcs.select("doc_no", "arc_pos").join(near, ["doc_no", "arc_pos"], "left_anti")


@query(f"{SQL_CENTRES}, s AS (SELECT doc_no, round(x / 300)::BIGINT AS gx, round(y / 300)::BIGINT AS gy, min(arc_pos) AS arc_pos FROM pp GROUP BY ALL) SELECT doc_no, arc_pos::INT AS arc_pos FROM s")
def first_of_place(spark, d):
    """Arcs of one place count once: the first stays."""
    arcs, _ = centres(spark, d)
    g = lambda c: F.round(F.col(c) / 300).cast("bigint")
    return arcs.groupBy("doc_no", g("x").alias("gx"), g("y").alias("gy")).agg(F.min("arc_pos").alias("arc_pos")).select("doc_no", "arc_pos")


@query(f"""WITH {P1_RECORDS},
c AS (SELECT doc_no, CASE WHEN isfinite(TRY_CAST(item->>'confidence' AS DOUBLE)) THEN TRY_CAST(item->>'confidence' AS DOUBLE) END AS conf, coalesce(item->>'style', '') AS style FROM records WHERE child = 'primitives')
SELECT doc_no, count(*) AS n_primitives, count(*) FILTER (style = 'hachure') AS n_hachures,
  coalesce(sum(round(conf * 10000)::BIGINT * 100) FILTER (style <> 'hachure') // nullif(count(conf) FILTER (style <> 'hachure'), 0), 0)::BIGINT AS mean_conf_ppm,
  round(coalesce(avg((conf < 0.6)::INT) FILTER (style <> 'hachure' AND conf IS NOT NULL), 0), 6) AS low_ratio FROM c GROUP BY doc_no""")
def document_confidence(spark, d):
    """Mean confidence and share of low ones per document, hachures left out."""
    p = records(spark, d, "primitives").select("doc_no", F.col("confidence").alias("conf"), F.coalesce("style", F.lit("")).alias("style"))
    main = F.when(F.col("style") != "hachure", F.col("conf"))
    mean = F.expr("sum(cast(round(case when style <> 'hachure' then conf end * 10000) as bigint) * 100) div nullif(count(case when style <> 'hachure' then conf end), 0)")
    low = F.round(F.coalesce(F.avg((main < 0.6).cast("int")), F.lit(0.0)), 6)
    return p.groupBy("doc_no").agg(F.count("*").alias("n_primitives"), F.count_if(F.col("style") == "hachure").alias("n_hachures"), F.coalesce(mean, F.lit(0)).alias("mean_conf_ppm"), low.alias("low_ratio"))


# --- graph documents

SQL_GRAPH = """WITH g AS (SELECT file_no, body::JSON AS body FROM artifact_files WHERE kind = 'graph' AND json_valid(body) AND json_type(body) = 'OBJECT'),
e AS (SELECT file_no, (i->>'id')::INT AS edge, (i->>'source')::INT AS source, (i->>'target')::INT AS target, (i->>'is_closed')::BOOL AS is_closed FROM (SELECT file_no, unnest((body->'edges')::JSON[]) AS i FROM g)),
n AS (SELECT file_no, (i->>'id')::INT AS node, (i->>'x')::DOUBLE AS x, (i->>'y')::DOUBLE AS y, i->>'type' AS type FROM (SELECT file_no, unnest((body->'nodes')::JSON[]) AS i FROM g)),
dg AS (SELECT file_no, node, count(*) AS degree FROM (SELECT file_no, source AS node FROM e WHERE NOT is_closed UNION ALL SELECT file_no, target FROM e WHERE NOT is_closed) GROUP BY ALL)"""


def graph_tables(spark: SparkSession, d: str) -> graphs.Graphs:
    return graphs.Graphs(table(spark, d, "artifact_files"))


@query(f"{SQL_GRAPH} SELECT type, coalesce(degree, 0) AS degree, count(*) AS n_nodes FROM n LEFT JOIN dg USING (file_no, node) GROUP BY ALL")
def degree_histogram(spark, d):
    """Nodes by type and degree over all graph documents."""
    g = graph_tables(spark, d)
    return g.nodes_with_degree().groupBy("type", "degree").agg(F.count("*").alias("n_nodes"))


SQL_LENGTHS = f"""{SQL_GRAPH},
l AS (SELECT e.*, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS length, p.degree AS dp, q.degree AS dq FROM e JOIN n a ON a.file_no = e.file_no AND a.node = source JOIN n b ON b.file_no = e.file_no AND b.node = target
  JOIN dg p ON p.file_no = e.file_no AND p.node = source JOIN dg q ON q.file_no = e.file_no AND q.node = target)"""


@query(f"{SQL_LENGTHS} SELECT file_no, edge, round(length, 4) AS length FROM l WHERE NOT is_closed AND length < {SPUR} AND least(dp, dq) = 1 AND greatest(dp, dq) >= 2")
def graph_spurs(spark, d):
    """Short loose ends; the graphs of the tables are paths, so an end at a node of two edges counts already."""
    return rounded(graph_tables(spark, d).spurs(SPUR, 2).select("file_no", "edge", "length"), "length")


@query(f"{SQL_GRAPH}, kept AS (SELECT e.* FROM e JOIN n a ON a.file_no = e.file_no AND a.node = source JOIN n b ON b.file_no = e.file_no AND b.node = target WHERE is_closed OR sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) >= {SPUR}) SELECT file_no, node FROM n WHERE EXISTS (SELECT 1 FROM kept k WHERE k.file_no = n.file_no AND (k.source = n.node OR k.target = n.node))")
def used_nodes(spark, d):
    """Nodes that still have an edge after the short ones are gone."""
    g = graph_tables(spark, d)
    return g.used(g.edges_with_length().where(F.col("is_closed") | (F.col("length") >= SPUR)))


@query(f"""{SQL_GRAPH}, o AS (SELECT file_no, source AS node, target AS other FROM e WHERE NOT is_closed UNION ALL SELECT file_no, target, source FROM e WHERE NOT is_closed),
u AS (SELECT o.file_no, o.node, (b.x - a.x) / nullif(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 0) AS dx, (b.y - a.y) / nullif(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 0) AS dy FROM o JOIN n a ON a.file_no = o.file_no AND a.node = o.node JOIN n b ON b.file_no = o.file_no AND b.node = o.other),
s AS (SELECT file_no, node, count(*) AS degree, greatest(-1, least(1, (sum(dx) ** 2 + sum(dy) ** 2 - sum(dx * dx + dy * dy)) / 2)) AS dot FROM u GROUP BY ALL)
SELECT file_no, node, round(degrees(acos(dot)), 2) AS angle FROM s WHERE degree = 2""")
def through_angles(spark, d):
    """Angle between the two edges at each node of degree two; 180 degrees is straight on."""
    return rounded(graph_tables(spark, d).through_angles(), "angle", to=2)


@query(f"""WITH RECURSIVE {SQL_GRAPH[5:]},
w AS (SELECT file_no, source AS a, target AS b FROM e WHERE source <> target UNION SELECT file_no, target, source FROM e WHERE source <> target),
reach AS (SELECT file_no, a, b FROM w UNION SELECT r.file_no, r.a, w.b FROM reach r JOIN w ON r.file_no = w.file_no AND r.b = w.a),
r AS (SELECT file_no, a AS node, least(a, min(b)) AS root FROM reach GROUP BY file_no, a)
SELECT file_no, count(DISTINCT coalesce(root, n.node)) AS n_components, count(*) AS n_nodes FROM n LEFT JOIN r USING (file_no, node) GROUP BY file_no""")
def graph_components(spark, d):
    """Connected components per graph document."""
    g = graph_tables(spark, d)
    roots = rel.grouped_within(g.edges().select("file_no", "source", "target"), "file_no", "source", "target").withColumnRenamed("source", "node")
    own = g.nodes().join(roots, ["file_no", "node"], "left")
    return own.groupBy("file_no").agg(F.countDistinct(F.coalesce("root", "node")).alias("n_components"), F.count("*").alias("n_nodes"))


# --- pixel sets

#: Pixels of the evaluation are cells of so many pixels of the document.
CELL = 40
SQL_CELLS = """WITH {0},
pts AS (SELECT doc_no, parent_pos AS prim, (item->>0)::DOUBLE AS x, (item->>1)::DOUBLE AS y FROM records WHERE child = 'points'),
t AS (SELECT DISTINCT doc_no, prim % {1} AS s, round(x / {2})::INT AS x, round(y / {2})::INT AS y FROM pts)""".format
SQL_SIDES = f"{SQL_CELLS(P1_RECORDS, 2, CELL)}, a AS (SELECT doc_no, x, y FROM t WHERE s = 0), b AS (SELECT doc_no, x, y FROM t WHERE s = 1)"


def cells(spark: SparkSession, d: str, parts: int) -> DataFrame:
    """Distinct cells of all points; the chains of a document are dealt to ``parts`` pixel sets that are compared with each other."""
    cell = lambda c: F.round(F.col(c) / CELL).cast("int").alias(c)
    return written(points(spark, d).select("doc_no", (F.col("prim") % parts).alias("s"), cell("x"), cell("y")).distinct(), "cells")


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = cells(spark, d, 2)
    return p.where("s = 0").drop("s"), p.where("s = 1").drop("s")


@query(f"""{SQL_SIDES},
u AS (SELECT doc_no, x, y, max(s) AS s, count(*) AS c FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY ALL)
SELECT doc_no, round(count(*) FILTER (c = 2) / count(*)::DOUBLE, 6) AS iou, round(coalesce(count(*) FILTER (c = 2) / nullif(count(*) FILTER (c = 2 OR s = 1), 0)::DOUBLE, 0), 6) AS precision,
  round(coalesce(count(*) FILTER (c = 2) / nullif(count(*) FILTER (c = 2 OR s = 2), 0)::DOUBLE, 0), 6) AS recall FROM u GROUP BY doc_no""")
def pixel_overlap(spark, d):
    """IoU, precision and recall of two pixel sets per document; one aggregation instead of a full outer join."""
    a, b = sides(spark, d)
    u = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("doc_no", "x", "y").agg(F.sum("s").alias("s"))
    both, first, second = F.count_if(F.col("s") == 3), F.count_if(F.col("s") != 2), F.count_if(F.col("s") != 1)
    share = lambda n: F.round(F.coalesce(F.try_divide(both.cast("double"), n), F.lit(0.0)), 6)
    return u.groupBy("doc_no").agg(share(F.count("*")).alias("iou"), share(first).alias("precision"), share(second).alias("recall"))


@query(f"{SQL_SIDES} SELECT doc_no, x, y FROM a UNION SELECT doc_no, x, y FROM b")
def mask_unions(spark, d):
    """All pixels of two masks of a document, each once."""
    a, b = sides(spark, d)
    return a.unionByName(b).distinct()


@query(f"{SQL_SIDES} SELECT a.doc_no, count(*) AS n_pixels, round(avg((b.x IS NULL)::INT), 6) AS isolation FROM a LEFT JOIN b ON a.doc_no = b.doc_no AND a.x = b.x AND a.y = b.y GROUP BY a.doc_no")
def isolation_ratios(spark, d):
    """Share of each document's foreground that no stroke covers."""
    a, b = sides(spark, d)
    own = a.join(b.withColumn("covered", F.lit(True)), ["doc_no", "x", "y"], "left")
    return own.groupBy("doc_no").agg(F.count("*").alias("n_pixels"), F.round(F.avg(F.col("covered").isNull().cast("int")), 6).alias("isolation"))


NEAREST = "SELECT a.doc_no, a.x, a.y, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM {0} a JOIN {1} b USING (doc_no) GROUP BY ALL".format


@query(f"""{SQL_SIDES}, m AS ({NEAREST('a', 'b')}), k AS ({NEAREST('b', 'a')}), z AS (SELECT doc_no, quantile_cont(d, 0.95) AS p95 FROM (SELECT doc_no, d FROM m UNION ALL SELECT doc_no, d FROM k) GROUP BY 1)
SELECT doc_no, round(p, 6) AS there, round(q, 6) AS back, round((p + q) / 2, 6) AS chamfer, round(p95, 6) AS p95 FROM (SELECT doc_no, avg(d) AS p FROM m GROUP BY 1) JOIN (SELECT doc_no, avg(d) AS q FROM k GROUP BY 1) USING (doc_no) JOIN z USING (doc_no)""")
def chamfer_distances(spark, d):
    """Directed and symmetric Chamfer distance of two pixel sets per document, and the 95th percentile over both directions."""
    own = geo.chamfer_both(*sides(spark, d), ["doc_no"], 8.0)
    return rounded(own.select("doc_no", "there", "back", "chamfer", "p95"), "there", "back", "chamfer", "p95", to=6)


SQL_STAGES = f"""{SQL_CELLS(P1_RECORDS, 4, CELL)},
m AS (SELECT a.doc_no, b.s, a.x, a.y, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM t a JOIN t b ON a.doc_no = b.doc_no AND a.s = 0 AND b.s > 0 GROUP BY ALL),
k AS (SELECT b.doc_no, b.s, b.x, b.y, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM t a JOIN t b ON a.doc_no = b.doc_no AND a.s = 0 AND b.s > 0 GROUP BY ALL),
c AS (SELECT doc_no, s, (p + q) / 2 AS c FROM (SELECT doc_no, s, avg(d) AS p FROM m GROUP BY ALL) JOIN (SELECT doc_no, s, avg(d) AS q FROM k GROUP BY ALL) USING (doc_no, s)),
w AS (SELECT doc_no, max(c) FILTER (s = 1) AS s1, max(c) FILTER (s = 2) AS s2, max(c) FILTER (s = 3) AS s3 FROM c GROUP BY doc_no)"""


@query(f"""{SQL_STAGES} SELECT coalesce(doc_no::VARCHAR, '__ALL__') AS doc, round(avg(s1), 6) AS first_stage, round(avg(s2), 6) AS second_stage, round(avg(s3), 6) AS third_stage, round(avg(s2 - s1), 6) AS second_added, round(avg(s3 - s2), 6) AS third_added
FROM w GROUP BY ROLLUP (doc_no)""")
def stage_attribution(spark, d):
    """Chamfer distance of the truth to the results of three stages, and what the later stages added; with the mean over all documents."""
    p = cells(spark, d, 4)
    later = p.where("s > 0")
    truth = p.where("s = 0").drop("s").join(later.select("doc_no", "s").distinct(), "doc_no")
    own = geo.chamfer_both(truth, later, ["doc_no", "s"], 8.0)
    at = lambda s: F.max(F.when(F.col("s") == s, F.col("chamfer"))).alias(f"s{s}")
    wide = own.groupBy("doc_no").agg(at(1), at(2), at(3))
    mean = lambda c: F.round(F.avg(F.expr(c)), 6)
    doc = F.coalesce(F.col("doc_no").cast("string"), F.lit("__ALL__"))
    return wide.rollup("doc_no").agg(doc.alias("doc"), mean("s1").alias("first_stage"), mean("s2").alias("second_stage"), mean("s3").alias("third_stage"), mean("s2 - s1").alias("second_added"), mean("s3 - s2").alias("third_added")).drop("doc_no")


RING = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


@query(f"""{SQL_CELLS(P1_RECORDS, 1, 100)}, p AS (SELECT DISTINCT doc_no AS grid, x, y FROM t), b AS (SELECT p.*, """ + ", ".join(f"EXISTS (SELECT 1 FROM p q WHERE q.grid = p.grid AND q.x = p.x + ({i}) AND q.y = p.y + ({j}))::INT AS n{k}" for k, (i, j) in enumerate(RING)) + " FROM p) SELECT grid, x, y, (" + " + ".join(f"abs(n{k} - n{(k + 1) % 8})" for k in range(8)) + ")::INT // 2 AS crossing FROM b")
def crossing_numbers(spark, d):
    """Crossing number of every pixel of the documents' coarse point masks."""
    cell = lambda c: F.round(F.col(c) / 100).cast("int").alias(c)
    p = points(spark, d).select(F.col("doc_no").alias("grid"), cell("x"), cell("y"))
    return geo.crossing_numbers(p, ["grid"]).select("grid", "x", "y", "crossing")


# --- zero-shot curation

#: Classes of prompts, the scale of the softmax, and the general gate.  Fixed values.
POSITIVE, SCALE, NEGATIVE_AT, MARGIN, PROMPTS = 4, 100.0, 0.05, 0.45, 64
#: Negative classes that are refused from a score of their own on, whatever the positive one.  Fixed values.  The embeddings' labels
#: from ``POSITIVE`` on stand for them in this order.
HARD = {
    "line_plot": 0.04, "xy_plot": 0.045, "frequency_plot": 0.035, "chart_axes": 0.06, "bar_chart": 0.12,
    "timeline_chart": 0.03, "table_text": 0.08, "ui_screen": 0.09, "block_diagram": 0.075, "flowchart": 0.075,
}


@query(f"""WITH v AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i), p AS (SELECT label, list(v ORDER BY i) AS p FROM v GROUP BY label),
c AS (SELECT vec_id, p.label, {SCALE} * list_cosine_similarity(embedding::DOUBLE[], p) AS c FROM embeddings e, p), w AS (SELECT vec_id, label, exp(c - max(c) OVER (PARTITION BY vec_id)) AS w FROM c),
z AS (SELECT vec_id, label, w / sum(w) OVER (PARTITION BY vec_id) AS s FROM w),
b AS (SELECT vec_id, arg_max(label, s) FILTER (label < {POSITIVE}) AS pos_label, max(s) FILTER (label < {POSITIVE}) AS p, arg_max(label, s) FILTER (label >= {POSITIVE}) AS neg_label, max(s) FILTER (label >= {POSITIVE}) AS n FROM z GROUP BY vec_id)
SELECT vec_id, pos_label, round(p, 5) AS pos_score, neg_label, round(n, 5) AS neg_score, CASE {" ".join(f"WHEN neg_label = {POSITIVE + k} AND n >= {v} THEN 'hard_{c}'" for k, (c, v) in enumerate(HARD.items()))} WHEN n >= {NEGATIVE_AT} AND p - n <= {MARGIN} THEN 'soft_' || neg_label ELSE 'keep' END AS decision FROM b""")
def zero_shot(spark, d):
    """Best positive and negative class prompt of every embedding, and the decision: the class's own limit, then the general gate.

    The prompts are the class means; scores are a softmax over scaled cosine likeness.
    """
    e = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    prompts = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("p")).select("label", unit(F.col("p")).alias("p"))
    rows = [(r["label"], r["p"]) for r in prompts.orderBy("label").limit(PROMPTS + 1).collect()]  # a prompt per class
    if len(rows) > PROMPTS:
        raise ValueError(f"zero_shot has prompts for {PROMPTS} classes at most")
    all_prompts = F.array(*[F.struct(F.lit(k).alias("label"), F.array(*map(F.lit, p)).alias("p")) for k, p in rows])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = e.select("vec_id", unit(F.col("embedding")).alias("v")).withColumn("s", F.transform(all_prompts, lambda q: F.struct((SCALE * dot(F.col("v"), q["p"])).alias("w"), q["label"].alias("label"))))
    own = own.withColumn("top", F.array_max("s")["w"]).withColumn("s", F.transform("s", lambda x: F.struct(F.exp(x["w"] - F.col("top")).alias("w"), x["label"].alias("label"))))
    own = own.withColumn("z", F.aggregate("s", F.lit(0.0), lambda t, x: t + x["w"]))
    best = lambda keep: F.array_max(F.filter("s", keep))
    own = own.withColumn("pos", best(lambda x: x["label"] < POSITIVE)).withColumn("neg", best(lambda x: x["label"] >= POSITIVE))
    p, n = F.col("pos.w") / F.col("z"), F.col("neg.w") / F.col("z")
    hard = None
    for k, (c, v) in enumerate(HARD.items()):
        hit = (F.col("neg.label") == POSITIVE + k) & (n >= v)
        hard = F.when(hit, f"hard_{c}") if hard is None else hard.when(hit, f"hard_{c}")
    decision = hard.when((n >= NEGATIVE_AT) & (p - n <= MARGIN), F.concat(F.lit("soft_"), F.col("neg.label").cast("string"))).otherwise("keep")
    return own.select("vec_id", F.col("pos.label").alias("pos_label"), F.round(p, 5).alias("pos_score"), F.col("neg.label").alias("neg_label"), F.round(n, 5).alias("neg_score"), decision.alias("decision"))
