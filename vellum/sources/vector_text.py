"""Vector formats as text, built per primitive by expressions and joined in order: SVG, DXF, diagram XML; and SVG paths back.

Primitives and labels come as the typed rows of ``nested.shred``; chains as one array of points per primitive.  Coordinates have two
decimals, in CAD four.  Images run downwards, CAD upwards: DXF turns the Y axis at the document's own height and mirrors arcs.

Defined results: elements that lack a number, chains of too few points for their kind and records of other variants have no element; an
unknown style is ``visible``; a label without text or position has no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers with line type and weight in 1/100 mm, and dash patterns (fixed values).
LAYERS = {
    "visible": ("CONTINUOUS", 50), "hidden": ("DASHED", 25), "center": ("CENTER", 25), "construction": ("CONTINUOUS", 13),
    "hachure": ("CONTINUOUS", 18), "text": ("CONTINUOUS", 25), "leader": ("CONTINUOUS", 18),
}
DASH = {"hidden": "8,4", "center": "12,3,2,3"}
#: Narrowest and widest stroke, stroke of leaders, text sizes, how far a centre cross reaches over its circle (fixed values).
NARROW, WIDE, LEADER, SVG_TEXT, DXF_TEXT, CROSS = 1.0, 30.0, 0.7, 14, 12, 1.15


def number(c: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", c.cast("double"))


def said(*parts: str | Column) -> Column:
    """Text and columns as one text; null if a column is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def style_of(style: Column) -> Column:
    return F.when(style.isin(*LAYERS), style).otherwise("visible")


def looked_up(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def chained(pts: Column, between: str, step: str) -> Column:
    """Points as text: ``x<between>y``, joined by ``step``."""
    return F.array_join(F.transform(pts, lambda p: said(number(p["x"]), between, number(p["y"]))), step)


def svg_elements(p: DataFrame) -> DataFrame:
    """Typed primitives (with ``pts`` and the document's ``stroke_width``, which goes before the style's weight) with their SVG element."""
    n = lambda k: number(F.col(k))
    style = style_of(F.col("style"))
    own = F.when(F.col("stroke_width").isNotNull(), F.greatest(F.lit(NARROW), F.least(F.lit(WIDE), F.col("stroke_width"))))
    width = number(F.coalesce(own, looked_up({k: w / 25 for k, (_, w) in LAYERS.items()}, style)))
    dash = F.coalesce(looked_up({k: f' stroke-dasharray="{d}"' for k, d in DASH.items()}, style), F.lit(""))
    tail = said(' stroke="black" stroke-width="', width, '" fill="none"', dash, "/>")
    line = said('<line x1="', n("p1_0"), '" y1="', n("p1_1"), '" x2="', n("p2_0"), '" y2="', n("p2_1"), '"', tail)
    circle = said('<circle cx="', n("center_0"), '" cy="', n("center_1"), '" r="', n("radius"), '"', tail)
    turn = F.when(F.col("angle") == 0, "").otherwise(said(' transform="rotate(', n("angle"), " ", n("center_0"), " ", n("center_1"), ')"'))
    ellipse = said('<ellipse cx="', n("center_0"), '" cy="', n("center_1"), '" rx="', n("a"), '" ry="', n("b"), '"', turn, tail)
    end = lambda a: said(number(F.col("center_0") + F.col("radius") * F.cos(F.radians(a))), " ", number(F.col("center_1") + F.col("radius") * F.sin(F.radians(a))))
    large = F.when(F.pmod(F.col("end_angle") - F.col("start_angle"), F.lit(360.0)) > 180, "1").otherwise("0")
    arc = said('<path d="M ', end("start_angle"), " A ", n("radius"), " ", n("radius"), " 0 ", large, " 1 ", end("end_angle"), '"', tail)
    chain = lambda name: said(f'<{name} points="', chained(F.col("pts"), ",", " "), '"', tail)
    v = F.col("variant")
    el = F.when(v == "line", line).when(v == "circle", circle).when(v == "ellipse", ellipse).when(v == "arc", arc)
    el = el.when((v == "polyline") & (F.size("pts") >= 2), chain("polyline")).when((v == "polygon") & (F.size("pts") >= 3), chain("polygon"))
    return p.withColumn("element", el).where("element is not null")


def has_text() -> Column:
    return (F.col("label") != "") & F.col("at").isNotNull()


def leader_pairs() -> Column:
    """Ends of a label's leaders; one without any leads straight to where it points."""
    lone = F.array(F.struct(F.col("at").alias("p1"), F.col("leader_to").alias("p2")))
    drawn = F.transform(F.filter("leaders", lambda r: r["p1"].isNotNull() & r["p2"].isNotNull()), lambda r: F.struct(r["p1"].alias("p1"), r["p2"].alias("p2")))
    return F.when((F.size("leaders") == 0) & F.col("leader_to").isNotNull() & F.col("at").isNotNull(), lone).otherwise(drawn)


def joined_parts(a: DataFrame, lines: Column, rest: list[Column], between: str) -> DataFrame:
    parts = F.concat(lines, F.array_compact(F.array(*rest)))
    return a.withColumn("element", F.when(F.size(parts) > 0, F.array_join(parts, between))).where("element is not null")


def svg_annotations(a: DataFrame) -> DataFrame:
    """Labels (``label``, ``at``, ``leader_to`` and ``leaders`` with ``p1``, ``p2``, as points ``x, y``) with their SVG elements: leaders, the crop as an
    image if there is one (``crop`` with ``box``), the text."""
    xy = lambda p, i: said(f'x{i}="', number(p["x"]), f'" y{i}="', number(p["y"]), '"')
    lines = F.transform(leader_pairs(), lambda r: said("<line ", xy(r["p1"], 1), " ", xy(r["p2"], 2), f' stroke="black" stroke-width="{LEADER}"/>'))
    image = F.lit(None).cast("string")
    if "crop" in a.columns:
        image = said('<image href="data:image/png;base64,', F.base64("crop"), '" x="', number(F.col("box")[0]), '" y="', number(F.col("box")[1]), '" width="', number(F.col("box")[2]), '" height="', number(F.col("box")[3]), '"/>')
    safe = F.replace(F.replace(F.replace("label", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.when(has_text(), said('<text x="', number(F.col("at.x")), '" y="', number(F.col("at.y")), f'" font-size="{SVG_TEXT}" font-family="Arial" fill="black">', safe, "</text>"))
    return joined_parts(a, lines, [image, text], "\n")


def svg_frame(width: Column, height: Column, body: Column) -> Column:
    """A whole SVG document on a white ground."""
    w, h = number(width), number(height)
    head = said('<svg xmlns="http://www.w3.org/2000/svg" width="', w, 'px" height="', h, 'px" viewBox="0 0 ', w, " ", h, '">\n<rect x="0" y="0" width="', w, '" height="', h, '" fill="white"/>\n')
    return F.concat(head, F.when(body != "", F.concat(body, F.lit("\n"))).otherwise(""), F.lit("</svg>"))


def pair(code: int, c: Column) -> Column:
    """A group code with its value, each on a line; CAD takes four decimals."""
    return said(f"{code}\n", number(c, 4), "\n")


def turned_point(code: int, x: Column, y: Column) -> Column:
    return F.concat(pair(code, x), pair(code + 10, F.col("height") - y))


def entity(name: str, layer: str | Column) -> Column:
    return said(f"0\n{name}\n8\n", layer, "\n")


def dxf_line(layer: str | Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.concat(entity("LINE", layer), turned_point(10, x1, y1), turned_point(11, x2, y2))


def dxf_entities(p: DataFrame) -> DataFrame:
    """Typed primitives (with ``pts`` and the document's ``height``) with their DXF entities, one layer per style; circles get a centre cross."""
    c = F.col
    layer = F.upper(style_of(c("style")))
    v = c("variant")
    line = dxf_line(layer, c("p1_0"), c("p1_1"), c("p2_0"), c("p2_1"))
    centre = F.concat(turned_point(10, c("center_0"), c("center_1")), pair(40, c("radius")))
    reach = CROSS * c("radius")
    cross = F.concat(dxf_line("CENTER", c("center_0") - reach, c("center_1"), c("center_0") + reach, c("center_1")), dxf_line("CENTER", c("center_0"), c("center_1") + reach, c("center_0"), c("center_1") - reach))
    circle = F.concat(entity("CIRCLE", layer), centre, cross)
    mirrored = lambda a: F.pmod(-c(a), F.lit(360.0))
    arc = F.concat(entity("ARC", layer), centre, pair(50, mirrored("end_angle")), pair(51, mirrored("start_angle")))
    turn = F.radians(-c("angle"))
    ratio = F.when(c("a") > 0, F.greatest(F.least(c("b") / c("a"), F.lit(1.0)), F.lit(1e-6))).otherwise(F.lit(1.0))
    ellipse = F.concat(entity("ELLIPSE", layer), turned_point(10, c("center_0"), c("center_1")), pair(11, c("a") * F.cos(turn)), pair(21, c("a") * F.sin(turn)), said("40\n", F.format_string("%.6f", ratio), "\n41\n0.000000\n42\n6.283185\n"))
    vertices = F.array_join(F.transform("pts", lambda q: F.concat(pair(10, q["x"]), pair(20, c("height") - q["y"]))), "")
    closed = v == "polygon"
    chain = F.concat(entity("LWPOLYLINE", layer), said("90\n", F.size("pts").cast("string"), "\n70\n", F.when(closed, "1").otherwise("0"), "\n"), vertices)
    long_enough = F.size("pts") >= F.when(closed, 3).otherwise(2)
    el = F.when(v == "line", line).when(v == "circle", circle).when(v == "arc", arc).when(v == "ellipse", ellipse).when(v.isin("polyline", "polygon") & long_enough, chain)
    return p.withColumn("element", el).where("element is not null")


def dxf_annotations(a: DataFrame) -> DataFrame:
    """Labels (as for SVG, with the document's ``height``) with their DXF entities: leaders on LEADER, the text on TEXT; line breaks become spaces."""
    lines = F.transform(leader_pairs(), lambda r: dxf_line("LEADER", r["p1"]["x"], r["p1"]["y"], r["p2"]["x"], r["p2"]["y"]))
    text = F.when(has_text(), F.concat(entity("MTEXT", "TEXT"), turned_point(10, F.col("at.x"), F.col("at.y")), pair(40, F.lit(float(DXF_TEXT))), F.lit("1\n"), F.regexp_replace("label", r"[\r\n]+", " "), F.lit("\n")))
    return joined_parts(a, lines, [text], "")


def dxf_head() -> str:
    """Header and layer table of a document of the 2010 release."""
    layers = "".join(f"0\nLAYER\n2\n{name.upper()}\n70\n0\n62\n7\n6\n{kind}\n370\n{weight}\n" for name, (kind, weight) in LAYERS.items())
    return f"0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1024\n0\nENDSEC\n0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nLAYER\n70\n{len(LAYERS)}\n{layers}0\nENDTAB\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n"


def dxf_frame(body: Column) -> Column:
    """A whole DXF document."""
    return F.concat(F.lit(dxf_head()), body, F.lit("0\nENDSEC\n0\nEOF\n"))


def in_order(elements: DataFrame, by: str, order: str, text: str, between: str = "\n") -> DataFrame:
    """The texts of each group joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return elements.groupBy(by).agg(F.array_join(parts, between).alias("body"), F.count("*").alias("n_elements"))


def diagram_cells(nodes: DataFrame, edges: DataFrame, waypoints: str | None = None) -> DataFrame:
    """Cells of a diagram document: a box per node, an edge per stroke, with the inner points of ``waypoints`` (an array of ``x, y``) if it has some."""
    size = F.when(F.col("type") == "junction", 16).otherwise(14)
    box = said('<mxCell id="n', F.col("node").cast("string"), '" vertex="1" parent="1"><mxGeometry x="', number(F.col("x") - size / 2), '" y="', number(F.col("y") - size / 2), '" width="', size.cast("string"), '" height="', size.cast("string"), '" as="geometry"/></mxCell>')
    inner = F.lit("")
    if waypoints:
        points = F.transform(F.slice(waypoints, F.lit(2), F.greatest(F.size(waypoints) - 2, F.lit(0))), lambda p: said('<mxPoint x="', number(p["x"]), '" y="', number(p["y"]), '"/>'))
        inner = F.when(F.size(points) > 0, said('<Array as="points">', F.array_join(points, ""), "</Array>")).otherwise("")
    line = said('<mxCell id="e', F.col("edge").cast("string"), '" edge="1" parent="1" source="n', F.col("source").cast("string"), '" target="n', F.col("target").cast("string"), '"><mxGeometry relative="1" as="geometry">', inner, "</mxGeometry></mxCell>")
    place = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")).alias("place")
    return nodes.select("file_no", place(0, "node"), box.alias("cell")).unionByName(edges.select("file_no", place(1, "edge"), line.alias("cell")))


def diagram_frame(body: Column) -> Column:
    return said('<mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>\n', body, "\n</root></mxGraphModel>")
