"""Many small files into few well-sized ones.

``compact_files`` joins Parquet files without decoding them: footers are read in parallel, files of one schema are packed
towards the target size, and every group is one task that copies encoded row groups and writes a new footer, with one source
open at a time.  Schema, block counts and row totals are validated; a mismatch raises.  A target is written under a temporary name
and renamed over what an earlier attempt left, so readers see the old file or the new one, and a repeated task never adds to it.

``current_documents`` picks the documents that a folder listing holds once each, by their place (file and row) in the listing's own
Parquet files.  Only keys and places are shuffled.  ``compact_documents`` then encodes each row group's share in one task, as small files,
and joins these; bodies never leave the task that reads them.

Defined results: files that are no Parquet files raise; an empty input gives an empty table; bodies that are null, empty,
cut off or no JSON object are no documents; ties in ``created_at`` go to the larger ``file_no``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.session import fresh_path, written
from vellum.sources.parquet_blocks import FILE_GROUPS, GROUP_ROWS, join_files, read_footer

TARGET_BYTES = 8 << 20
#: One planning bucket holds so many targets' bytes and files on average; planning never gathers all files in one task.
BUCKET_TARGETS, BUCKET_FILES = 64, 200_000
#: Bytes of text that are encoded as one small file.
PIECE_BYTES = 1 << 18
#: Rows that are decoded at once.
BATCH_ROWS = 4_096
REPORT = "path string, n_files bigint, n_blocks bigint, n_rows bigint, n_bytes bigint"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a plain local path."""
    uri = uri.removeprefix("file:") if uri.startswith("file:/") else uri
    return (pafs.LocalFileSystem(), "/" + uri.lstrip("/")) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def listed(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """Path and length of the Parquet files in a folder and all below it.

    Folders are listed level by level in tasks, so millions of files never meet on the driver; names that start with a dot or an
    underscore are left out.
    """

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                fs, base = opened(path)
                found = fs.get_file_info(pafs.FileSelector(base, recursive=False))
                rows = [(f"{path.rstrip('/')}/{f.base_name}", f.size or 0, f.type == pafs.FileType.Directory) for f in found if f.base_name[0] not in "._"]
                yield pd.DataFrame(rows, columns=["path", "n_bytes", "is_folder"]).astype({"n_bytes": "int64", "is_folder": "bool"})

    level, files = spark.createDataFrame([(folder,)], "path string"), None
    while True:
        entries = written(level.mapInPandas(look, "path string, n_bytes bigint, is_folder boolean"), "listing")
        own = entries.where(~F.col("is_folder") & F.col("path").endswith(suffix)).select("path", "n_bytes")
        files = own if files is None else files.unionByName(own)
        level = entries.where("is_folder").select("path")
        if not level.take(1):
            return files
        level = level.repartition(F.col("path"))


def footers(files: DataFrame) -> DataFrame:
    """Block count, row total and schema print of each file, from its footer alone."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, size in zip(frame["path"], frame["n_bytes"]):
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    footer = read_footer(f, size)
                rows.append((path, size, footer.blocks, footer.rows, hashlib.sha256(footer.schema).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "n_bytes", "n_blocks", "n_rows", "schema_print"])

    return files.mapInPandas(read, "path string, n_bytes bigint, n_blocks bigint, n_rows bigint, schema_print string")


def planned(files: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """Files with the group they go to: files of one schema, in buckets of bounded expected size, cut at every ``target`` bytes."""
    many = F.greatest(F.lit(1), F.ceil(F.sum("n_bytes") / (target * BUCKET_TARGETS)), F.ceil(F.count("*") / BUCKET_FILES))
    own = files.join(files.groupBy("schema_print").agg(many.alias("n_buckets")), "schema_print").withColumn("bucket", F.pmod(F.xxhash64("path"), F.col("n_buckets")))
    before = F.sum("n_bytes").over(Window.partitionBy("schema_print", "bucket").orderBy("path")) - F.col("n_bytes")
    return own.withColumn("cut", F.floor(before / target)).withColumn("group_no", F.concat_ws("-", "schema_print", "bucket", "cut"))


def one_by_one(paths: list[str], sizes: list[int]) -> Iterator[tuple[pa.NativeFile, int]]:
    """Each file opened when its turn comes and closed when the next one's does."""
    for path, size in zip(paths, sizes):
        fs, name = opened(path)
        with fs.open_input_file(name) as f:
            yield f, int(size)


def compact_files(files: DataFrame, folder: str, target: int = TARGET_BYTES) -> DataFrame:
    """Join the listed Parquet files into ``folder``; one row per written file with its validated totals."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("path")
        group = frame["group_no"].iloc[0]
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        name, part = f"{base}/part-{group}.parquet", f"{base}/_part-{group}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(part) as out:
            footer = join_files(one_by_one(frame["path"].tolist(), frame["n_bytes"].tolist()), out)
        size = fs.get_file_info(part).size
        with fs.open_input_file(part) as f:
            again = read_footer(f, size)
        if (again.rows, again.blocks, again.schema) != (int(frame["n_rows"].sum()), int(frame["n_blocks"].sum()), footer.schema):
            raise ValueError(f"{group}: totals differ from those of its sources")
        fs.move(part, name)  # over the file of an earlier attempt at this group, if there is one
        return pd.DataFrame([(name, len(frame), again.blocks, again.rows, size)], columns=["path", "n_files", "n_blocks", "n_rows", "n_bytes"])

    return planned(footers(files), target).groupBy("group_no").applyInPandas(join, REPORT)


#: What a compacted document has.
DOCUMENT = pa.schema([("file_no", pa.int64()), ("kind", pa.string()), ("patent_id", pa.string()), ("path", pa.string()), ("created_at", pa.timestamp("us", "UTC")), ("body", pa.string())])
FIELDS = DOCUMENT.names


def scanned(files: DataFrame) -> DataFrame:
    """The listing with the place of each row: ``at`` (its Parquet file) and ``row``; a listing that is no plain scan is written first."""
    place = [F.col("_metadata.file_path").alias("at"), F.col("_metadata.row_index").alias("row")]
    if "_metadata" not in files._jdf.queryExecution().analyzed().metadataOutput().toString():
        files = written(files.select(*FIELDS, "deleted_at"), "listing")
    return files.select(*FIELDS, "deleted_at", *place)


def is_document(rows: DataFrame) -> DataFrame:
    """Keys and places of live graph and primitives files whose body is a complete JSON object, with the sketch it names (as JSON text if it is no text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sketches = [], []
            for k, body in enumerate(batch.column("body").to_pylist()):
                try:
                    document = json.loads(body)
                except (ValueError, RecursionError):
                    continue
                if isinstance(document, dict):
                    keep.append(k)
                    sketch = document.get("sketch_id")
                    sketches.append(sketch if isinstance(sketch, str) else json.dumps(sketch))
            kept = batch.drop_columns(["body"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sketches, pa.string())], names=[*kept.schema.names, "sketch_id"])

    live = rows.where("kind in ('graph', 'primitives') and deleted_at is null and body is not null")
    keys = ["file_no", "kind", "patent_id", "created_at", "at", "row"]
    return live.select(*keys, "body").mapInArrow(read, "file_no bigint, kind string, patent_id string, created_at timestamp, at string, row bigint, sketch_id string")


def current_documents(rows: DataFrame) -> DataFrame:
    """``(at, row)``: the places of the last version of each document; only keys are shuffled for the choice."""
    last = F.max(F.struct("created_at", "file_no", "at", "row")).alias("last")
    return is_document(rows).groupBy("kind", "patent_id", "sketch_id").agg(last).select("last.at", "last.row")


def blocks_of(places: DataFrame) -> DataFrame:
    """Places by the row group that holds them: ``(at, block, rows)``, rows counted from the block's first."""

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["at"]:
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    groups = read_footer(f, f.size()).meta[FILE_GROUPS][1][1]
                rows.append((path, np.cumsum([0] + [g[GROUP_ROWS][1] for g in groups])[:-1].tolist()))
            yield pd.DataFrame(rows, columns=["at", "starts"])

    known = places.select("at").distinct().mapInPandas(starts, "at string, starts array<bigint>")
    own = places.join(known, "at").withColumn("block", F.size(F.filter("starts", lambda s: s <= F.col("row"))) - 1)
    return own.groupBy("at", "block").agg(F.sort_array(F.collect_list(F.col("row") - F.get("starts", F.col("block")))).alias("rows"))


def encoded_rows(batch: pa.RecordBatch, rows: np.ndarray) -> pa.Table:
    """Some rows of a batch in the form of documents; times without a zone are UTC."""
    taken = pa.Table.from_batches([batch]).select(FIELDS).take(pa.array(rows))
    at = taken["created_at"]
    return taken.set_column(FIELDS.index("created_at"), "created_at", at.cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")) if at.type.tz is None else at).cast(DOCUMENT)


def encoded_pieces(blocks: DataFrame, folder: str, piece: int = PIECE_BYTES) -> DataFrame:
    """The rows of each block as small Parquet files of about ``piece`` bytes of text; ``(path, n_bytes)`` of what was written.

    A block is decoded batch by batch.  Names follow from the block and the piece, so a repeated task replaces its own files.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = opened(folder)
        target.create_dir(base, recursive=True)
        for frame in frames:
            for at, block, rows in zip(frame["at"], frame["block"], frame["rows"]):
                fs, name = opened(at)
                stem, rows = hashlib.sha256(f"{at}#{block}".encode()).hexdigest()[:32], np.asarray(rows)
                held, size, done, first = [], 0, [], 0

                def flush() -> None:
                    path = f"{base}/piece-{stem}-{len(done)}.parquet"
                    part = f"{base}/_piece-{uuid.uuid4().hex}.tmp"
                    with target.open_output_stream(part) as out:
                        pq.write_table(pa.concat_tables(held).combine_chunks(), out, row_group_size=1 << 30, compression="zstd")
                    target.move(part, path)
                    done.append((path, target.get_file_info(path).size))
                    held.clear()

                with fs.open_input_file(name) as f:
                    for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(batch_size=BATCH_ROWS, row_groups=[int(block)], columns=FIELDS):
                        own = rows[np.searchsorted(rows, first) : np.searchsorted(rows, first + len(batch))] - first
                        first += len(batch)
                        if not len(own):
                            continue
                        part = encoded_rows(batch, own)
                        for k in range(0, len(part), 16):
                            held.append(part.slice(k, 16))
                            size += held[-1].nbytes
                            if size >= piece:
                                flush()
                                size = 0
                if held:
                    flush()
                yield pd.DataFrame(done, columns=["path", "n_bytes"])

    # few bytes of places are much work: a task per block, as far as there are tasks
    many = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(many, "at", "block").mapInPandas(write, "path string, n_bytes bigint")


def compact_documents(files: DataFrame, target: int = TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The compacted documents, read from the large files, and the report of the files written."""
    spark = files.sparkSession
    small, large = fresh_path(spark, "small-files"), fresh_path(spark, "large-files")
    rows = scanned(files)
    pieces = written(encoded_pieces(blocks_of(current_documents(rows)), small), "pieces")
    report = written(compact_files(pieces, large, target), "compaction-report")
    schema = rows.select(*FIELDS).schema
    if not report.take(1):
        return spark.createDataFrame([], schema), report
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(large), report
