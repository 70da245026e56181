"""A command classifier for strokes: native features, a multinomial logistic model trained here, held-out figures."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ["straightness", "closure", "turning", "bend", "spread"]


def stroke_features(df: DataFrame, stroke: str = "stroke") -> DataFrame:
    """Features of each stroke that do not depend on place, size or turn; higher-order functions, no shuffle."""
    p = F.col(stroke)
    d = F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    rows = df.withColumn("_d", d).withColumn("_length", F.aggregate("_d", F.lit(0.0), lambda s, v: s + F.hypot(v["x"], v["y"])))
    first, last, mid = F.get(p, F.lit(0)), F.element_at(p, -1), F.element_at(p, (F.size(p) / 2).cast("int") + 1)
    chord = F.hypot(last["x"] - first["x"], last["y"] - first["y"])
    cross = F.zip_with(F.slice("_d", 2, F.size("_d") - 1), F.slice("_d", 1, F.size("_d") - 1), lambda b, a: F.atan2(a["x"] * b["y"] - a["y"] * b["x"], a["x"] * b["x"] + a["y"] * b["y"]))
    off = F.abs((mid["x"] - first["x"]) * (last["y"] - first["y"]) - (mid["y"] - first["y"]) * (last["x"] - first["x"]))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, v: s + f(v))
    return rows.withColumns({"straightness": safe(chord, F.col("_length")), "closure": F.exp(-safe(chord, F.col("_length")) * 10), "turning": F.abs(total(cross, lambda v: v)), "bend": safe(off, F.col("_length") * F.greatest(chord, F.lit(1e-9))), "spread": safe(total(cross, F.abs), F.size(cross).cast("double"))}).drop("_d", "_length")


def held_out(key: Column, tenths: int = 2) -> Column:
    """Whether a row is kept for testing; by hash, so it does not depend on order."""
    return F.pmod(F.xxhash64(key), F.lit(10)) < tenths


def trained(rows: DataFrame, label: str, rounds: int = 40) -> PipelineModel:
    """A multinomial logistic regression; every pass is one tree aggregation over the partitions."""
    stages = [StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=FEATURES, outputCol="_features"), LogisticRegression(labelCol="_label", featuresCol="_features", maxIter=rounds, regParam=1e-4)]
    return Pipeline(stages=stages).fit(rows)


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with ``guess``."""
    names = model.stages[0].labels
    return model.transform(rows).withColumn("guess", F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))).drop("_label", "_features", "rawPrediction", "probability", "prediction")


#: Commands by number, and the numbers of a command's vector (fixed values).
COMMANDS, NUMBERS = {"LINE": 0, "ARC": 1, "CIRCLE": 2, "POLYLINE": 3}, 6


def encoded_commands(df: DataFrame, command: str = "command") -> DataFrame:
    """Commands with ``type_id`` and ``params``: ends of a line; centre, radius and turns of an arc; centre and radius of a circle; zeros for a polyline."""
    c = F.col(command)
    turn = F.radians(c["start_angle"])
    values = {
        "LINE": [c["x"], c["y"], c["x"] + c["size"] * F.cos(turn), c["y"] + c["size"] * F.sin(turn)],
        "ARC": [c["x"], c["y"], c["size"], c["start_angle"] / 360.0, (c["start_angle"] + c["span"]) / 360.0],
        "CIRCLE": [c["x"], c["y"], c["size"]],
    }
    params, number = F.array(*[F.lit(0.0)] * NUMBERS), F.lit(COMMANDS["POLYLINE"])
    for name, own in values.items():
        params = F.when(c["type"] == name, F.array(*own, *[F.lit(0.0)] * (NUMBERS - len(own)))).otherwise(params)
        number = F.when(c["type"] == name, COMMANDS[name]).otherwise(number)
    return df.withColumns({"type_id": number, "params": params})
