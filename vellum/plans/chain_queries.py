"""Queries over the point chains of the primitive documents: lengths, directions, fits, vertices and encodings, with their SQL.

Each reads and parses every document once and computes a chain from its own array of points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import geometry as geo
from vellum.operators import nested
from vellum.plans.data_queries import P1_RECORDS
from vellum.plans.registry import registry
from vellum.session import table

QUERIES, ORACLES, query = registry()
BY = ["doc_no", "prim"]
#: Chains of the documents have steps of hundreds of pixels, strokes of a raster have steps of one: this many pixels of a
#: document stand for one of the limits below, which are those of strokes.
UNIT = 100.0
#: Below these lengths edges are micro and short; length over which a direction is taken; points of an encoded chain.
MICRO, SHORT, BASELINE, SLOTS = 6.0, 15.0, 8.0, 32
#: Vertices of a grid of so many pixels are one; degrees of a turn that make a corner (fixed value).
GRID, TURN = 50, 35.0

SQL_POINTS = f"""WITH {P1_RECORDS},
pts AS (SELECT doc_no, parent_pos AS prim, pos AS k, (item->>0)::DOUBLE AS x, (item->>1)::DOUBLE AS y FROM records WHERE child = 'points')"""
SQL_STEPS = f"""{SQL_POINTS},
s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM pts WINDOW w AS (PARTITION BY doc_no, prim ORDER BY k)),
l AS (SELECT doc_no, prim, count(*) AS n, sum(step) AS length FROM s GROUP BY ALL)"""
SQL_FITS = f"""{SQL_POINTS},
m AS (SELECT doc_no, prim, count(*) AS n, avg(x) AS mx, avg(y) AS my, arg_min(x, k) AS ax, arg_min(y, k) AS ay, arg_max(x, k) AS bx, arg_max(y, k) AS by_ FROM pts GROUP BY ALL),
c AS (SELECT doc_no, prim, k, x - mx AS u, y - my AS v FROM pts JOIN m USING (doc_no, prim)),
sm AS (SELECT doc_no, prim, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(ax - mx) AS au, any_value(ay - my) AS av, any_value(bx - mx) AS bu, any_value(by_ - my) AS bv, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, (sum(u*u*u) + sum(u*v*v)) / 2 AS r1, (sum(v*v*v) + sum(v*u*u)) / 2 AS r2 FROM c JOIN m USING (doc_no, prim) GROUP BY doc_no, prim),
dt AS (SELECT *, uu * vv - uv * uv AS det, 0.5 * atan2(2 * uv, uu - vv) AS t, sqrt((au - bu) ** 2 + (av - bv) ** 2) AS chord FROM sm),
f AS (SELECT *, CASE WHEN abs(det) > 1e-9 * (uu + vv) * (uu + vv) THEN (r1 * vv - r2 * uv) / det END AS ca, CASE WHEN abs(det) > 1e-9 * (uu + vv) * (uu + vv) THEN (r2 * uu - r1 * uv) / det END AS cb FROM dt),
g AS (SELECT *, sqrt(ca * ca + cb * cb + (uu + vv) / n) AS radius FROM f),
r AS (SELECT g.*, (degrees(atan2(v - cb, u - ca)) + 360) % 360 AS angle, abs(-c.u * sin(t) + v * cos(t)) AS lo, abs(sqrt((u - ca) ** 2 + (v - cb) ** 2) - radius) AS co,
      CASE WHEN chord > 5 THEN abs((u - au) * (av - bv) - (v - av) * (au - bu)) / chord END AS bulge FROM c JOIN g USING (doc_no, prim)),
fit AS (SELECT doc_no, prim, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(ca) AS ca, any_value(cb) AS cb, any_value(radius) AS radius, any_value(chord) AS chord, any_value(uu) AS uu, any_value(vv) AS vv, any_value(det) AS det,
      avg((lo <= 1.5)::INT) AS line_inliers, sqrt(avg(lo * lo)) AS line_rms, avg((co <= 1.5)::INT) AS circle_inliers, sqrt(avg(co * co)) AS circle_rms, max(bulge) AS sagitta
      FROM r GROUP BY doc_no, prim),
conf AS (SELECT *, line_inliers * greatest(0, 1 - line_rms / 3.0) AS line, coalesce(CASE WHEN n >= 5 THEN circle_inliers * greatest(0, 1 - circle_rms / 3.0) END, 0) AS arc FROM fit)"""


def chains(spark: SparkSession, d: str) -> DataFrame:
    return nested.chains(table(spark, d, "primitive_docs"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """The chains' points as rows."""
    return chains(spark, d).select(*BY, F.inline("pts"))


def rounded(df: DataFrame, *cols: str, to: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in cols})


@query(f"{SQL_STEPS} SELECT doc_no, prim::INT AS prim, n, round(length, 4) AS length FROM l")
def chain_lengths(spark, d):
    """Arc length of every point chain."""
    return rounded(geo.chain_features(chains(spark, d)).select(*BY, "n", "length"), "length")


@query(f"""{SQL_STEPS}
SELECT doc_no, count(*) AS n_chains, round(median(length), 4) AS median_length, round(avg((length < {MICRO * UNIT})::INT), 6) AS micro, round(avg((length < {SHORT * UNIT})::INT), 6) AS short
FROM l GROUP BY doc_no""")
def chain_statistics(spark, d):
    """Median length and shares of micro and short chains per document."""
    own = geo.chain_features(chains(spark, d))
    share = lambda most: F.round(F.avg((F.col("length") < most).cast("int")), 6)
    return own.groupBy("doc_no").agg(F.count("*").alias("n_chains"), F.round(F.median("length"), 4).alias("median_length"), share(MICRO * UNIT).alias("micro"), share(SHORT * UNIT).alias("short"))


@query(f"""{SQL_STEPS},
e AS (SELECT doc_no, count(*) AS n, avg((length < {MICRO * UNIT})::INT) AS micro, avg((length < {SHORT * UNIT})::INT) AS short FROM l GROUP BY doc_no)
SELECT doc_no, n >= 4 AND (micro >= 0.20 OR short >= 0.80) AS cleanup FROM e""")
def cleanup_triggers(spark, d):
    """Whether a document is fragmented enough for the removal of hachures: share of micro or short chains.

    The documents hold few chains, so four count where a graph needs forty edges.
    """
    s = chain_statistics(spark, d)
    return s.select("doc_no", ((F.col("n_chains") >= 4) & ((F.col("micro") >= 0.20) | (F.col("short") >= 0.80))).alias("cleanup"))


@query(f"""{SQL_STEPS},
r AS (SELECT *, sum(step) OVER (PARTITION BY doc_no, prim ORDER BY k) AS run FROM s),
e AS (SELECT doc_no, prim, arg_min(x, k) AS ax, arg_min(y, k) AS ay, coalesce(arg_min(x, k) FILTER (run >= {BASELINE * UNIT}), arg_max(x, k)) AS bx, coalesce(arg_min(y, k) FILTER (run >= {BASELINE * UNIT}), arg_max(y, k)) AS by_ FROM r GROUP BY ALL)
SELECT doc_no, prim::INT AS prim, round(degrees(atan2(by_ - ay, bx - ax)), 4) AS direction FROM e""")
def chain_directions(spark, d):
    """Direction in which each chain leaves its first point."""
    return chains(spark, d).select(*BY, F.round(geo.leave_direction(F.col("pts"), BASELINE * UNIT), 4).alias("direction"))


@query(f"{SQL_FITS} SELECT doc_no, prim::INT AS prim, n, round(line_inliers, 4) AS inliers, round(line_rms, 4) AS rms, round(line, 4) AS confidence FROM conf")
def line_fits(spark, d):
    """Total least squares line of every chain."""
    return rounded(geo.line_fits(chains(spark, d)).select(*BY, "n", "inliers", "rms", "confidence"), "inliers", "rms", "confidence")


@query(f"""{SQL_FITS},
o AS (SELECT *, abs(det) > 1e-2 * (uu + vv) * (uu + vv) AS bent FROM conf WHERE radius > 1e-3)
SELECT doc_no, prim::INT AS prim, n, bent, round(CASE WHEN bent THEN mx + ca END, 3) AS cx, round(CASE WHEN bent THEN my + cb END, 3) AS cy, round(CASE WHEN bent THEN radius END, 3) AS radius,
       round(CASE WHEN bent THEN circle_inliers * greatest(0, 1 - circle_rms / 3.0) END, 4) AS confidence FROM o""")
def circle_fits(spark, d):
    """Algebraic circle of every chain; what is nearly straight, so that its centre is ill defined, is marked and has no centre."""
    own = geo.with_circles(geo.with_moments(chains(spark, d))).where("radius is not null")
    own = own.withColumn("bent", F.expr("abs(s.uu * s.vv - s.uv * s.uv) > 1e-2 * (s.uu + s.vv) * (s.uu + s.vv)"))
    at = lambda c, to: F.round(F.when(F.col("bent"), F.col(c)), to)
    return own.select(*BY, "n", "bent", at("cx", 3).alias("cx"), at("cy", 3).alias("cy"), at("radius", 3).alias("radius"), at("circle", 4).alias("confidence"))


@query(f"""{SQL_FITS},
w AS (SELECT *, chord > 5 AND NOT (sagitta / chord >= 0.05 AND sagitta >= 2.5) AND line >= 0.50 AS flat FROM conf),
t AS (SELECT *, CASE WHEN n < 2 THEN 'polyline' WHEN line >= 0.75 THEN 'line' WHEN arc >= 0.65 THEN CASE WHEN flat THEN 'line' ELSE 'arc' END
      WHEN greatest(arc, line) > 0.2 THEN CASE WHEN n < 5 OR line > arc OR flat THEN 'line' ELSE 'arc' END ELSE 'polyline' END AS type FROM w)
SELECT doc_no, prim::INT AS prim, n, type, round(CASE WHEN n < 2 THEN 0 WHEN type = 'polyline' THEN 0.3 WHEN type = 'arc' THEN arc ELSE line END, 4) AS confidence FROM t""")
def straight_or_round(spark, d):
    """Line, arc or polyline for every chain: the cascade of fits for open strokes without its ellipses, which SQL can't fit."""
    return rounded(geo.fit_choice(chains(spark, d), ellipses=False).select(*BY, "n", "type", "confidence"), "confidence")


@query()
def chain_types(spark, d):
    """Line, arc, ellipse or polyline for every chain, by the whole cascade."""
    return rounded(geo.fit_choice(chains(spark, d)).select(*BY, "n", "type", "confidence"), "confidence")


@query()
def closed_types(spark, d):
    """Circle, ellipse, polygon or closed polyline for every polygon's chain."""
    return rounded(geo.closed_choice(chains(spark, d).where("closed")).select(*BY, "type", "confidence"), "confidence")


@query(f"""{SQL_FITS},
sel AS (SELECT doc_no, prim, angle, co, count(*) FILTER (co <= 1.5) OVER (PARTITION BY doc_no, prim) AS k FROM r WHERE radius > 1e-3),
own AS (SELECT doc_no, prim, angle FROM sel WHERE k < 5 OR co <= 1.5),
gp AS (SELECT doc_no, prim, angle AS e, coalesce(lead(angle) OVER w, first(angle) OVER (PARTITION BY doc_no, prim ORDER BY angle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + 360) AS s FROM own WINDOW w AS (PARTITION BY doc_no, prim ORDER BY angle)),
widest AS (SELECT *, row_number() OVER (PARTITION BY doc_no, prim ORDER BY s - e DESC, e) AS place FROM gp)
SELECT doc_no, prim::INT AS prim, round(s % 360, 2) AS start, round(e, 2) AS "end", round(360 - (s - e), 2) AS span FROM widest WHERE place = 1""")
def arc_spans(spark, d):
    """Where the arc of each chain around its fitted circle starts and ends, and how far it reaches."""
    return rounded(geo.arc_spans(chains(spark, d)).select(*BY, "start", "end", "span"), "start", "end", "span", to=2)


@query(f"""{SQL_POINTS},
m AS (SELECT doc_no, prim, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY ALL),
a AS (SELECT doc_no, prim, (degrees(atan2(y - my, x - mx)) + 360) % 360 AS angle FROM pts JOIN m USING (doc_no, prim)),
g AS (SELECT doc_no, prim, coalesce(lead(angle) OVER w, first(angle) OVER w2 + 360) - angle AS gap FROM a
      WINDOW w AS (PARTITION BY doc_no, prim ORDER BY angle), w2 AS (PARTITION BY doc_no, prim ORDER BY angle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_no, prim::INT AS prim, round(max(gap), 4) AS gap FROM g GROUP BY ALL""")
def angular_gaps(spark, d):
    """Largest angular gap of each chain's points around their mean."""
    own = geo.centred(chains(spark, d))
    angles = F.transform("uv", lambda p: F.pmod(F.degrees(F.atan2(p["v"], p["u"])), F.lit(360.0)))
    return own.select(*BY, F.round(geo.largest_gap(angles)["gap"], 4).alias("gap"))


@query(f"""{SQL_STEPS},
m AS (SELECT doc_no, prim, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY ALL),
d AS (SELECT doc_no, prim, sqrt((x - mx) ** 2 + (y - my) ** 2) AS r FROM pts JOIN m USING (doc_no, prim)),
q AS (SELECT doc_no, prim, count(*) AS n, avg(r) AS r, stddev_pop(r) AS spread FROM d GROUP BY ALL),
z AS (SELECT q.*, length, q.n >= 6 AND r >= 1 AND spread < r * CASE WHEN r < 12 THEN 0.55 ELSE 0.30 END AS is_round FROM q JOIN l USING (doc_no, prim) WHERE (doc_no, prim) IN (SELECT (doc_no, pos) FROM records WHERE child = 'primitives' AND item->>'type' = 'polygon'))
SELECT doc_no, prim::INT AS prim, is_round AS round, length < {80 * UNIT} AND NOT is_round AS noise FROM z""")
def noise_loops(spark, d):
    """Closed chains that are round, and those that are short and are not: noise."""
    return geo.circular(chains(spark, d).where("closed"), 80 * UNIT).select(*BY, "round", "noise")


@query(f"""{SQL_FITS},
st AS (SELECT doc_no, prim, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM pts WINDOW w AS (PARTITION BY doc_no, prim ORDER BY k)),
ln AS (SELECT doc_no, prim, sum(step) AS length FROM st GROUP BY ALL),
h AS (SELECT conf.*, length FROM conf JOIN ln USING (doc_no, prim))
SELECT doc_no, prim::INT AS prim, round(length, 4) AS length, round(line_rms, 4) AS rms, round(line, 4) AS confidence FROM h
WHERE length BETWEEN {5 * UNIT} AND {80 * UNIT} AND coalesce(chord / nullif(length, 0), 0) >= 0.70 AND line_rms <= {2.2 * UNIT}""")
def line_like_chains(spark, d):
    """Chains that could be hachures, with the line that would replace each."""
    own = geo.line_fits(geo.chain_features(chains(spark, d)).drop("n"))
    limits = (geo.STROKE[0] * UNIT, geo.STROKE[1] * UNIT, geo.STROKE[2], geo.STROKE[3] * UNIT)
    return rounded(own.where(geo.line_like(F.col("length"), F.col("straightness"), F.col("rms"), limits)).select(*BY, "length", "rms", "confidence"), "length", "rms", "confidence")


@query(f"""{SQL_POINTS},
g AS (SELECT doc_no, prim, k, x, y, round(x / {GRID})::BIGINT AS gx, round(y / {GRID})::BIGINT AS gy FROM pts),
e AS (SELECT *, lead(gx) OVER w AS hx, lead(gy) OVER w AS hy, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM g WINDOW w AS (PARTITION BY doc_no, prim ORDER BY k)),
o AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS len FROM e WHERE hx IS NOT NULL AND (gx <> hx OR gy <> hy)),
s AS (SELECT doc_no, gx, gy, (x2 - x) / len AS dx, (y2 - y) / len AS dy FROM o UNION ALL SELECT doc_no, hx, hy, (x - x2) / len, (y - y2) / len FROM o),
v AS (SELECT doc_no, gx, gy, count(*) AS degree, (sum(dx) ** 2 + sum(dy) ** 2 - sum(dx * dx + dy * dy)) / 2 AS dot FROM s GROUP BY ALL)
SELECT doc_no, CASE WHEN degree = 1 THEN 'endpoint' WHEN degree >= 3 THEN 'junction' ELSE 'corner' END AS kind, count(*) AS n FROM v WHERE degree <> 2 OR dot > cos(radians(180 - {TURN})) GROUP BY ALL""")
def vertex_kinds(spark, d):
    """End points, corners and junctions of the chains' vertices merged on a grid.

    A vertex of two segments is a corner if they turn by more than ``TURN`` degrees: of two unit vectors, half the squared
    length of their sum less their own is the cosine between them, so no segment meets another by a join.
    """
    grid = lambda c: F.round(F.col(f"p.{c}") / GRID).cast("bigint")
    n = F.greatest(F.size("pts") - 1, F.lit(0))
    steps = chains(spark, d).select("doc_no", F.explode(F.arrays_zip(F.slice("pts", F.lit(1), n).alias("p"), F.slice("pts", F.lit(2), n).alias("q"))).alias("s")).select("doc_no", "s.*")
    at = lambda p: F.struct(*[F.round(F.col(f"{p}.{c}") / GRID).cast("bigint").alias(f"g{c}") for c in "xy"])
    e = steps.select("doc_no", at("p").alias("a"), at("q").alias("b"), (F.col("q.x") - F.col("p.x")).alias("dx"), (F.col("q.y") - F.col("p.y")).alias("dy")).where("a <> b")
    e = e.withColumn("len", F.hypot("dx", "dy")).withColumns({"dx": F.col("dx") / F.col("len"), "dy": F.col("dy") / F.col("len")})
    end = lambda v, sign: F.struct(F.col(f"{v}.gx").alias("gx"), F.col(f"{v}.gy").alias("gy"), (F.col("dx") * sign).alias("dx"), (F.col("dy") * sign).alias("dy"))
    s = e.select("doc_no", F.inline(F.array(end("a", 1.0), end("b", -1.0))))
    dot = (F.sum("dx") * F.sum("dx") + F.sum("dy") * F.sum("dy") - F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))) / 2
    v = s.groupBy("doc_no", "gx", "gy").agg(F.count("*").alias("degree"), dot.alias("dot")).where((F.col("degree") != 2) | (F.col("dot") > F.cos(F.radians(F.lit(180 - TURN)))))
    return v.groupBy("doc_no", F.when(F.col("degree") == 1, "endpoint").when(F.col("degree") >= 3, "junction").otherwise("corner").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""{SQL_POINTS},
i AS (SELECT doc_no, prim, list(x ORDER BY k) AS xs, list(y ORDER BY k) AS ys, count(*) AS n FROM pts GROUP BY ALL)
SELECT doc_no, prim::INT AS prim, t::INT AS slot, CASE WHEN n <= {SLOTS} THEN coalesce(xs[t + 1], -1) ELSE xs[round_even(t * (n - 1) / {SLOTS - 1}.0, 0)::INT + 1] END AS x, CASE WHEN n <= {SLOTS} THEN coalesce(ys[t + 1], -1) ELSE ys[round_even(t * (n - 1) / {SLOTS - 1}.0, 0)::INT + 1] END AS y
FROM i, range({SLOTS}) r(t)""")
def encoded_chains(spark, d):
    """Chains in 32 slots: short ones as they are with -1 behind, long ones thinned evenly."""
    n = F.size("pts")
    place = lambda t: F.when(n <= SLOTS, t).otherwise(F.bround(t * (n - 1) / (SLOTS - 1)).cast("int"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda t: F.struct(t.alias("slot"), F.coalesce(F.get("pts", place(t))["x"], F.lit(-1.0)).alias("x"), F.coalesce(F.get("pts", place(t))["y"], F.lit(-1.0)).alias("y")))
    return chains(spark, d).select(*BY, F.inline(slots))
