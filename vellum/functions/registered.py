"""Functions for SQL users: native ones as SQL expressions, one table function over SVG texts in Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Name, arguments, type and body; bodies are expressions that stay inside code generation.
FUNCTIONS = [
    ("plain_patent", "t STRING", "STRING", "CASE WHEN upper(regexp_replace(t, '[^A-Za-z0-9]', '')) RLIKE '^[A-Z]{2}[0-9]{7}([A-Z][0-9]?)?$' THEN left(upper(regexp_replace(t, '[^A-Za-z0-9]', '')), 9) ELSE upper(regexp_replace(t, '[^A-Za-z0-9]', '')) END"),
    ("angle_delta", "a DOUBLE, b DOUBLE", "DOUBLE", "least(pmod(abs(a - b), 180.0D), 180.0D - pmod(abs(a - b), 180.0D))"),
    ("point_segment", "x DOUBLE, y DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "hypot(x - x1 - greatest(0.0D, least(1.0D, coalesce(try_divide((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1), (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0.0D))) * (x2 - x1), y - y1 - greatest(0.0D, least(1.0D, coalesce(try_divide((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1), (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0.0D))) * (y2 - y1))"),
    ("fit_confidence", "inliers DOUBLE, rms DOUBLE", "DOUBLE", "inliers * greatest(0.0D, 1 - rms / 3)"),
]


@udtf(returnType="path int, step int, x double, y double")
class SvgPoints:
    """``svg_points(text)``: the points of all paths of an SVG text, cubics flattened."""

    def eval(self, text: str) -> Iterator[tuple[int, int, float, float]]:
        import re

        from vellum.sources.readers import flattened

        for path, d in enumerate(re.findall(r'<path[^>]*? d="([^"]*)"', text or "")):
            for step, (x, y) in enumerate(p for chain in flattened(d) for p in chain):
                yield path, step, float(x), float(y)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("svg_points", SvgPoints)
