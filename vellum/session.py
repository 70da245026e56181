"""Session helpers: the shared folder of the cluster and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing (unit tests in local mode) a temporary folder is set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vellum-")
        sc.setCheckpointDir(folder)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors; for clusters on which it is not installed."""
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; ``release`` deletes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Cut the lineage with a Parquet table (in folders of ``parts``) in the shared folder; later stages read its statistics.

    The table stays until ``discard`` or ``release``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing refers to any more; anything else is left alone."""
    for df in tables:
        path = getattr(df, "_written_at", None) if df is not None else None
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_made: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete all that this process has put into the shared folder; for callers that have stored the results of their queries."""
    while _made:
        delete(spark, _made.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
