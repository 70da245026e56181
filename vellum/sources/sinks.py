"""Sinks: delimited and line-JSON files in a fixed field order, partitioned artefacts, and moves as rows instead of side effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.keys import last_part


def write_csv(df: DataFrame, path: str, fields: list[str], one_file: bool = False) -> None:
    """CSV with a header and exactly these fields; fields that the table lacks are empty.

    ``one_file`` is for reports: it sends all rows through one task.
    """
    rows = df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, its keys in alphabetical order; null fields are kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_partitioned(df: DataFrame, path: str, by: str = "patent_id", rows_per_file: int = 100_000) -> None:
    """A folder per value; a value with many rows is spread over many files, no task holds one value whole."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def quarantine_moves(df: DataFrame, target: str, path: str = "path", group: str = "patent") -> DataFrame:
    """``(src, dst)`` of the files to move away; carrying it out is the caller's."""
    return df.select(F.col(path).alias("src"), F.concat_ws("/", F.lit(target.rstrip("/")), F.col(group), last_part(F.col(path))).alias("dst"))


def ensure_table(spark: SparkSession, name: str, columns: dict[str, str], path: str | None = None) -> None:
    """Create a Parquet table if there is none, and add the columns that it lacks; running it again changes nothing."""
    fields = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet" + (f" LOCATION '{path}'" if path else ""))
    have = {c.lower() for c in spark.table(name).columns}
    new = ", ".join(f"`{c}` {t}" for c, t in columns.items() if c.lower() not in have)
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({new})")


def append_rows(df: DataFrame, name: str) -> None:
    """Append rows by name; columns of the table that they lack are null."""
    have = {c.lower() for c in df.columns}
    own = [F.col(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in df.sparkSession.table(name).schema]
    df.select(*own).write.insertInto(name)


def json_documents(df: DataFrame, key: str) -> DataFrame:
    """``(key, body)``: every row as one JSON document of its other columns; NaN and infinite numbers become null, as JSON has none."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c != key]
    return df.select(key, F.to_json(F.struct(*clean), {"ignoreNullFields": "false", "pretty": "true"}).alias("body"))
