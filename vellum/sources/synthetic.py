"""Synthetic strokes with the command that drew them, as expressions over ``spark.range``; the same seed gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Families with their command and share (fixed values).
FAMILIES = [("line_short", "LINE", 0.20), ("line_mid", "LINE", 0.20), ("line_long", "LINE", 0.15), ("arc_mid", "ARC", 0.10), ("arc_long", "ARC", 0.05), ("circle", "CIRCLE", 0.12), ("polyline_curve", "POLYLINE", 0.10), ("polyline_corner", "POLYLINE", 0.08)]
LENGTH = {"line_short": (8, 24), "line_mid": (24, 80), "line_long": (80, 200), "arc_mid": (20, 60), "arc_long": (60, 110), "circle": (10, 60), "polyline_curve": (30, 90), "polyline_corner": (30, 90)}


def drawn_number(seed: int, name: str, extra: Column | None = None) -> Column:
    """A number from 0 to 1 that depends on the row, a name and perhaps a position only."""
    key = [F.lit(seed), F.lit(name), F.col("id")] + ([extra] if extra is not None else [])
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)


def synthetic_strokes(spark: SparkSession, n: int = 30_000, seed: int = 42, noise: float = 0.5) -> DataFrame:
    """``(id, kind, stroke, command)``; points carry noise of up to ``noise`` pixels."""
    u = drawn_number(seed, "kind")
    kind, command, low, high, total = None, None, None, None, 0.0
    for name, cmd, share in FAMILIES:
        total += share
        hit = u < total
        add = lambda c, v: F.when(hit, F.lit(v)) if c is None else c.when(hit, F.lit(v))  # noqa: B023, E731
        kind, command, low, high = add(kind, name), add(command, cmd), add(low, float(LENGTH[name][0])), add(high, float(LENGTH[name][1]))
    last = FAMILIES[-1]
    rows = spark.range(n).select("id", kind.otherwise(last[0]).alias("kind"), command.otherwise(last[1]).alias("type"), (low.otherwise(30.0) + drawn_number(seed, "size") * (high.otherwise(90.0) - low.otherwise(30.0))).alias("size"), (100 + 56 * drawn_number(seed, "x")).alias("x"), (100 + 56 * drawn_number(seed, "y")).alias("y"), (360 * drawn_number(seed, "turn")).alias("turn"), (30 + 300 * drawn_number(seed, "span")).alias("span"))
    rows = rows.withColumn("n", F.greatest(F.lit(8), (F.col("size") / 2).cast("int")))

    def point(k: Column) -> Column:
        t = k / (F.col("n") - 1)
        shake = lambda name: noise * 2 * (drawn_number(seed, name, k) - 0.5)
        angle = F.radians(F.col("turn") + F.when(F.col("type") == "CIRCLE", 360 * t).otherwise(F.col("span") * t))
        along = F.when(F.col("kind") == "polyline_corner", F.when(t < 0.5, t).otherwise(1 - t)).otherwise(t)
        side = F.when(F.col("kind") == "polyline_curve", F.sin(t * 6.283185307179586) * 0.2).when(F.col("kind") == "polyline_corner", t * 0.6).otherwise(0.0)
        c, s = F.cos(F.radians("turn")), F.sin(F.radians("turn"))
        curved = F.col("type").isin("ARC", "CIRCLE")
        px = F.when(curved, F.cos(angle)).otherwise(along * c - side * s)
        py = F.when(curved, F.sin(angle)).otherwise(along * s + side * c)
        return F.struct((F.col("x") + F.col("size") * px + shake("nx")).alias("x"), (F.col("y") + F.col("size") * py + shake("ny")).alias("y"))

    out = rows.withColumn("stroke", F.transform(F.sequence(F.lit(0), F.col("n") - 1), point))
    return out.select("id", "kind", "stroke", F.struct("type", "x", "y", F.col("size").alias("size"), F.col("turn").alias("start_angle"), F.when(F.col("type") == "ARC", F.col("span")).alias("span")).alias("command"))
