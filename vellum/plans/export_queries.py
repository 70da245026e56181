"""Queries that write the documents as SVG, DXF and diagram XML, and read SVG back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import nested
from vellum.plans.data_queries import P1_RECORDS
from vellum.plans.geometry_queries import SQL_GRAPH, graph_tables
from vellum.plans.registry import registry
from vellum.session import table, written
from vellum.sources import readers
from vellum.sources import vector_text as vec

QUERIES, ORACLES, query = registry()


def two(x: str) -> str:
    """Two decimals in SQL."""
    return f"printf('%.2f', ({x})::DOUBLE)"


J = "(item->>'$.{0}')::DOUBLE".format
STYLE = "CASE WHEN item->>'style' IN (" + ", ".join(f"'{k}'" for k in vec.LAYERS) + ") THEN item->>'style' ELSE 'visible' END"
WEIGHT = "CASE style " + " ".join(f"WHEN '{k}' THEN {w / 25}" for k, (_, w) in vec.LAYERS.items()) + " END"
DASHES = "CASE style " + " ".join(f"WHEN '{k}' THEN ' stroke-dasharray=\"{v}\"'" for k, v in vec.DASH.items()) + " ELSE '' END"
SQL_PRIMS = f"""WITH {P1_RECORDS},
head AS (SELECT doc_no, (body->>'$.image_size[0]')::DOUBLE AS width, (body->>'$.image_size[1]')::DOUBLE AS height, (body->>'$.stroke_width')::DOUBLE AS sw FROM good),
pts AS (SELECT doc_no, parent_pos AS pos, list((item->>0)::DOUBLE ORDER BY pos) AS xs, list((item->>1)::DOUBLE ORDER BY pos) AS ys FROM records WHERE child = 'points' GROUP BY doc_no, parent_pos),
pr AS (SELECT r.doc_no, r.pos, item->>'type' AS type, {STYLE} AS style, height, sw, xs, ys, {J('p1[0]')} AS ax, {J('p1[1]')} AS ay, {J('p2[0]')} AS bx, {J('p2[1]')} AS by_, {J('center[0]')} AS cx, {J('center[1]')} AS cy,
  {J('radius')} AS radius, {J('start_angle')} AS sa, {J('end_angle')} AS ea, {J('a')} AS ra, {J('b')} AS rb, {J('angle')} AS angle
  FROM (SELECT * FROM records WHERE child = 'primitives') r JOIN head USING (doc_no) LEFT JOIN pts USING (doc_no, pos)),
an AS (SELECT r.doc_no, r.pos, coalesce(item->>'text', '') AS label, height, {J('position[0]')} AS px, {J('position[1]')} AS py, {J('leader_to[0]')} AS tx, {J('leader_to[1]')} AS ty FROM (SELECT * FROM records WHERE child = 'annotations') r JOIN head USING (doc_no)),
ld AS (SELECT doc_no, parent_pos AS pos, pos AS k, {J('p1[0]')} AS ax, {J('p1[1]')} AS ay, {J('p2[0]')} AS bx, {J('p2[1]')} AS by_ FROM records WHERE child = 'leader_lines'),
lone AS (SELECT doc_no, pos, 0 AS k, px AS ax, py AS ay, tx AS bx, ty AS by_ FROM an WHERE tx IS NOT NULL AND px IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ld WHERE ld.doc_no = an.doc_no AND ld.pos = an.pos)),
leads AS (SELECT l.*, height FROM (SELECT * FROM ld WHERE ax IS NOT NULL AND bx IS NOT NULL UNION ALL SELECT * FROM lone) l JOIN head USING (doc_no))"""
CHAIN = f"array_to_string(list_transform(range(1, len(xs) + 1), lambda i: {two('xs[i]')} || '{{0}}' || {two('ys[i]')}), '{{1}}')".format
END = f"{two('cx + radius * cos(radians({0}))')} || ' ' || {two('cy + radius * sin(radians({0}))')}".format
SQL_SVG = f"""{SQL_PRIMS},
tail AS (SELECT *, ' stroke="black" stroke-width="' || {two(f'CASE WHEN sw IS NOT NULL THEN greatest({vec.NARROW}, least({vec.WIDE}, sw)) ELSE {WEIGHT} END')} || '" fill="none"' || {DASHES} || '/>' AS tail FROM pr),
el AS (SELECT doc_no, 0 AS kind, pos, 0 AS part, 0 AS k, CASE type
  WHEN 'line' THEN '<line x1="' || {two('ax')} || '" y1="' || {two('ay')} || '" x2="' || {two('bx')} || '" y2="' || {two('by_')} || '"' || tail
  WHEN 'circle' THEN '<circle cx="' || {two('cx')} || '" cy="' || {two('cy')} || '" r="' || {two('radius')} || '"' || tail
  WHEN 'ellipse' THEN '<ellipse cx="' || {two('cx')} || '" cy="' || {two('cy')} || '" rx="' || {two('ra')} || '" ry="' || {two('rb')} || '"' || CASE WHEN angle = 0 THEN '' ELSE ' transform="rotate(' || {two('angle')} || ' ' || {two('cx')} || ' ' || {two('cy')} || ')"' END || tail
  WHEN 'arc' THEN '<path d="M ' || {END('sa')} || ' A ' || {two('radius')} || ' ' || {two('radius')} || ' 0 ' || CASE WHEN (ea - sa + 720) % 360 > 180 THEN '1' ELSE '0' END || ' 1 ' || {END('ea')} || '"' || tail
  WHEN 'polyline' THEN CASE WHEN len(xs) >= 2 THEN '<polyline points="' || {CHAIN(',', ' ')} || '"' || tail END
  WHEN 'polygon' THEN CASE WHEN len(xs) >= 3 THEN '<polygon points="' || {CHAIN(',', ' ')} || '"' || tail END END AS element FROM tail
  UNION ALL SELECT doc_no, 1, pos, 0, k, '<line x1="' || {two('ax')} || '" y1="' || {two('ay')} || '" x2="' || {two('bx')} || '" y2="' || {two('by_')} || '" stroke="black" stroke-width="{vec.LEADER}"/>' FROM leads
  UNION ALL SELECT doc_no, 1, pos, 1, 0, '<text x="' || {two('px')} || '" y="' || {two('py')} || '" font-size="{vec.SVG_TEXT}" font-family="Arial" fill="black">' || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text>' FROM an WHERE label <> '' AND px IS NOT NULL)"""


def sized(spark: SparkSession, d: str) -> DataFrame:
    """Size and stroke width of every document."""
    return nested.headers(table(spark, d, "primitive_docs")).select("doc_no", "width", "height", "stroke_width")


class Drawing:
    """The typed records of all documents, written once, as the exporters take them."""

    def __init__(self, spark: SparkSession, d: str):
        docs = table(spark, d, "primitive_docs")
        self.records = written(nested.shred(docs, kinds=("primitives", "annotations", "leader_lines")), "drawn")
        self.chains = nested.chains(docs).select("doc_no", F.col("prim").alias("pos"), "pts")
        self.sizes = written(sized(spark, d), "sizes")

    def primitives(self) -> DataFrame:
        return self.records.where("child = 'primitives'").join(self.chains, ["doc_no", "pos"], "left").join(self.sizes, "doc_no")

    def labels(self) -> DataFrame:
        """Labels with their leaders in order."""
        at = lambda x: F.when(F.col(f"{x}_0").isNotNull() & F.col(f"{x}_1").isNotNull(), F.struct(F.col(f"{x}_0").alias("x"), F.col(f"{x}_1").alias("y")))
        leaders = self.records.where("child = 'leader_lines'").select("doc_no", F.col("parent_pos").alias("pos"), F.struct(F.col("pos").alias("k"), at("p1").alias("p1"), at("p2").alias("p2")).alias("r"))
        leaders = leaders.groupBy("doc_no", "pos").agg(F.array_sort(F.collect_list("r")).alias("leaders"))
        a = self.records.where("child = 'annotations'").select("doc_no", "pos", F.coalesce("text", F.lit("")).alias("label"), at("position").alias("at"), at("leader_to").alias("leader_to"))
        none = F.expr("cast(array() as array<struct<k: int, p1: struct<x: double, y: double>, p2: struct<x: double, y: double>>>)")
        return a.join(leaders, ["doc_no", "pos"], "left").withColumn("leaders", F.coalesce("leaders", none)).join(self.sizes, "doc_no")


def placed(primitives: DataFrame, annotations: DataFrame) -> DataFrame:
    """Elements of both kinds with their place in the document: primitives first."""
    parts = [df.select("doc_no", F.struct(F.lit(k).alias("kind"), "pos").alias("place"), "element") for k, df in enumerate((primitives, annotations))]
    return parts[0].unionByName(parts[1])


@query(f"""{SQL_SVG},
b AS (SELECT doc_no, string_agg(element, chr(10) ORDER BY kind, pos, part, k) AS body FROM el WHERE element IS NOT NULL GROUP BY doc_no)
SELECT doc_no, '<svg xmlns="http://www.w3.org/2000/svg" width="' || {two('width')} || 'px" height="' || {two('height')} || 'px" viewBox="0 0 ' || {two('width')} || ' ' || {two('height')} || '">' || chr(10) || '<rect x="0" y="0" width="' || {two('width')} || '" height="' || {two('height')} || '" fill="white"/>' || chr(10) || coalesce(body || chr(10), '') || '</svg>' AS svg
FROM head LEFT JOIN b USING (doc_no)""")
def svg_documents(spark, d):
    """The SVG of every document: its primitives, then its labels with their leaders."""
    own = Drawing(spark, d)
    body = vec.in_order(placed(vec.svg_elements(own.primitives()), vec.svg_annotations(own.labels())), "doc_no", "place", "element")
    return own.sizes.join(body, "doc_no", "left").select("doc_no", vec.svg_frame(F.col("width"), F.col("height"), F.coalesce("body", F.lit(""))).alias("svg"))


def sql_pair(code: int, x: str) -> str:
    return f"'{code}' || chr(10) || printf('%.4f', ({x})::DOUBLE) || chr(10)"


def sql_line(layer: str, a: str, b: str, c: str, e: str) -> str:
    return f"'0' || chr(10) || 'LINE' || chr(10) || '8' || chr(10) || {layer} || chr(10) || {sql_pair(10, a)} || {sql_pair(20, f'height - ({b})')} || {sql_pair(11, c)} || {sql_pair(21, f'height - ({e})')}"


def sql_head(name: str) -> str:
    return f"'0' || chr(10) || '{name}' || chr(10) || '8' || chr(10) || upper(style) || chr(10)"


CENTRE = f"{sql_pair(10, 'cx')} || {sql_pair(20, 'height - cy')} || {sql_pair(40, 'radius')}"
SQL_DXF = f"""{SQL_PRIMS},
el AS (SELECT doc_no, 0 AS kind, pos, 0 AS part, 0 AS k, CASE type
  WHEN 'line' THEN {sql_line('upper(style)', 'ax', 'ay', 'bx', 'by_')}
  WHEN 'circle' THEN {sql_head('CIRCLE')} || {CENTRE} || {sql_line("'CENTER'", f'cx - {vec.CROSS} * radius', 'cy', f'cx + {vec.CROSS} * radius', 'cy')} || {sql_line("'CENTER'", 'cx', f'cy + {vec.CROSS} * radius', 'cx', f'cy - {vec.CROSS} * radius')}
  WHEN 'arc' THEN {sql_head('ARC')} || {CENTRE} || {sql_pair(50, '(720 - ea) % 360')} || {sql_pair(51, '(720 - sa) % 360')}
  WHEN 'ellipse' THEN {sql_head('ELLIPSE')} || {sql_pair(10, 'cx')} || {sql_pair(20, 'height - cy')} || {sql_pair(11, 'ra * cos(radians(-angle))')} || {sql_pair(21, 'ra * sin(radians(-angle))')} || '40' || chr(10) || printf('%.6f', CASE WHEN ra > 0 THEN greatest(least(rb / ra, 1.0), 1e-6) ELSE 1.0 END) || chr(10) || '41' || chr(10) || '0.000000' || chr(10) || '42' || chr(10) || '6.283185' || chr(10)
  ELSE CASE WHEN len(xs) >= CASE type WHEN 'polygon' THEN 3 ELSE 2 END THEN {sql_head('LWPOLYLINE')} || '90' || chr(10) || len(xs) || chr(10) || '70' || chr(10) || CASE type WHEN 'polygon' THEN '1' ELSE '0' END || chr(10) || array_to_string(list_transform(range(1, len(xs) + 1), lambda i: {sql_pair(10, 'xs[i]')} || {sql_pair(20, 'height - ys[i]')}), '') END END AS element FROM pr
  UNION ALL SELECT doc_no, 1, pos, 0, k, {sql_line("'LEADER'", 'ax', 'ay', 'bx', 'by_')} FROM leads
  UNION ALL SELECT doc_no, 1, pos, 1, 0, '0' || chr(10) || 'MTEXT' || chr(10) || '8' || chr(10) || 'TEXT' || chr(10) || {sql_pair(10, 'px')} || {sql_pair(20, 'height - py')} || {sql_pair(40, str(vec.DXF_TEXT))} || '1' || chr(10) || regexp_replace(label, '[' || chr(13) || chr(10) || ']+', ' ', 'g') || chr(10) FROM an WHERE label <> '' AND px IS NOT NULL)"""


@query(f"""{SQL_DXF},
b AS (SELECT doc_no, string_agg(element, '' ORDER BY kind, pos, part, k) AS body FROM el WHERE element IS NOT NULL GROUP BY doc_no)
SELECT doc_no, '{vec.dxf_head()}' || coalesce(body, '') || '0' || chr(10) || 'ENDSEC' || chr(10) || '0' || chr(10) || 'EOF' || chr(10) AS dxf FROM head LEFT JOIN b USING (doc_no)""")
def dxf_documents(spark, d):
    """The DXF of every document, turned at its own height."""
    own = Drawing(spark, d)
    body = vec.in_order(placed(vec.dxf_entities(own.primitives()), vec.dxf_annotations(own.labels())), "doc_no", "place", "element", "")
    return own.sizes.join(body, "doc_no", "left").select("doc_no", vec.dxf_frame(F.coalesce("body", F.lit(""))).alias("dxf"))


@query(f"{SQL_SVG} SELECT doc_no, count(*) FILTER (starts_with(element, '<path')) AS n_paths FROM head LEFT JOIN el USING (doc_no) GROUP BY doc_no")
def svg_path_counts(spark, d):
    """How many paths each SVG holds; a text that is null counts as -1."""
    return svg_documents(spark, d).select("doc_no", readers.path_count(F.col("svg")).cast("bigint").alias("n_paths"))


@query(f"""{SQL_PRIMS}, u AS (SELECT doc_no, pos, xs, ys, unnest(range(len(xs))) AS k FROM pr WHERE (type = 'polyline' AND len(xs) >= 2) OR (type = 'polygon' AND len(xs) >= 3))
SELECT doc_no, round(sum(xs[k + 1]), 2) AS sum_x, round(sum(ys[k + 1]), 2) AS sum_y, count(*) AS n_points FROM u GROUP BY doc_no""")
def svg_round_trip(spark, d):
    """Points of polylines and polygons read back from the SVG texts: number and sums per document."""
    back = readers.svg_points(svg_documents(spark, d), "doc_no", "svg")
    return back.groupBy("doc_no").agg(F.round(F.sum("x"), 2).alias("sum_x"), F.round(F.sum("y"), 2).alias("sum_y"), F.count("*").alias("n_points"))


@query(f"""{SQL_GRAPH},
c AS (SELECT file_no, 0 AS kind, node AS id, '<mxCell id="n' || node || '" vertex="1" parent="1"><mxGeometry x="' || {two("x - CASE type WHEN 'junction' THEN 8 ELSE 7 END")} || '" y="' || {two("y - CASE type WHEN 'junction' THEN 8 ELSE 7 END")} || '" width="' || CASE type WHEN 'junction' THEN '16' ELSE '14' END || '" height="' || CASE type WHEN 'junction' THEN '16' ELSE '14' END || '" as="geometry"/></mxCell>' AS cell FROM n
  UNION ALL SELECT file_no, 1, edge, '<mxCell id="e' || edge || '" edge="1" parent="1" source="n' || source || '" target="n' || target || '"><mxGeometry relative="1" as="geometry"></mxGeometry></mxCell>' FROM e)
SELECT file_no, '<mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>' || chr(10) || string_agg(cell, chr(10) ORDER BY kind, id, cell) || chr(10) || '</root></mxGraphModel>' AS xml FROM c WHERE cell IS NOT NULL GROUP BY file_no""")
def diagram_documents(spark, d):
    """Diagram XML of every graph document that has a node."""
    g = graph_tables(spark, d)
    body = vec.in_order(vec.diagram_cells(g.nodes(), g.edges()).where("cell is not null"), "file_no", "place", "cell")
    return body.select("file_no", vec.diagram_frame(F.col("body")).alias("xml"))
