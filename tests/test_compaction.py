import datetime as dt
import io
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vellum.operators import compaction
from vellum.sources.parquet_blocks import encoded, join_files, read_footer, Reader


def block(rows, **how):
    out = io.BytesIO()
    pq.write_table(pa.table({"id": pa.array(rows, pa.int64()), "t": pa.array([None if r % 3 == 0 else f"text {r}" * (r % 5) for r in rows])}), out, **how)
    return out.getvalue()


@pytest.mark.parametrize("how", [{}, {"compression": "zstd", "row_group_size": 7}, {"use_dictionary": False, "write_page_index": True}, {"data_page_version": "2.0", "compression": "none"}])
def test_join_is_an_exact_round_trip(how):
    parts = [block(list(range(a, a + 50)), **how) for a in (0, 50, 100)]
    out = io.BytesIO()
    footer = join_files([(io.BytesIO(p), len(p)) for p in parts], out)
    table = pq.read_table(io.BytesIO(out.getvalue()))
    assert table.equals(pa.concat_tables([pq.read_table(io.BytesIO(p)) for p in parts]))
    assert footer.rows == 150 and footer.blocks == sum(pq.ParquetFile(io.BytesIO(p)).num_row_groups for p in parts)


def test_footer_codec_is_lossless():
    data = block(list(range(40)), row_group_size=9)
    size = int.from_bytes(data[-8:-4], "little")
    raw = data[-8 - size : -8]
    assert Reader(encoded(12, Reader(raw).struct())).struct() == Reader(raw).struct()


def test_other_schemas_and_broken_files_are_refused():
    other = io.BytesIO()
    pq.write_table(pa.table({"id": [1]}), other)
    good = block([1])
    with pytest.raises(ValueError):
        join_files([(io.BytesIO(good), len(good)), (io.BytesIO(other.getvalue()), len(other.getvalue()))], io.BytesIO())
    for bad in (b"", b"PAR1", good[:-1], good[:30]):
        with pytest.raises((ValueError, IndexError)):
            read_footer(io.BytesIO(bad), len(bad))


def test_many_small_files_become_few(spark, tmp_path):
    source = tmp_path / "small"
    for k in range(60):
        (source / f"d{k % 7}" / "x").mkdir(parents=True, exist_ok=True)
        (source / f"d{k % 7}" / "x" / f"f{k}.parquet").write_bytes(block(list(range(k * 10, k * 10 + 10))))
    (source / "_SUCCESS").write_bytes(b"")
    for _ in range(2):  # a second run replaces what the first has left
        report = compaction.compact_files(compaction.listed(spark, str(source)), str(tmp_path / "large"), 20_000).collect()
        assert sum(r["n_files"] for r in report) == 60 and len(report) < 12 and sum(r["n_rows"] for r in report) == 600
        assert sorted(f.name for f in (tmp_path / "large").iterdir()) == sorted(r["path"].rsplit("/", 1)[1] for r in report)
    got = spark.read.parquet(*[r["path"] for r in report])
    assert sorted(r["id"] for r in got.collect()) == list(range(600))


def test_one_source_is_open_at_a_time(tmp_path):
    """3,000 files are joined with few handles to spare."""
    import resource

    paths = []
    for k in range(3_000):
        paths.append(str(tmp_path / f"f{k}.parquet"))
        (tmp_path / f"f{k}.parquet").write_bytes(block([3 * k + 1]))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (min(soft, 512), hard))
    try:
        out = io.BytesIO()
        footer = join_files(compaction.one_by_one(paths, [(tmp_path / f"f{k}.parquet").stat().st_size for k in range(3_000)]), out)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert footer.rows == footer.blocks == 3_000
    assert pq.read_table(io.BytesIO(out.getvalue()), columns=["id"])["id"].to_pylist() == [3 * k + 1 for k in range(3_000)]


def test_bodies_are_not_shuffled(spark, tmp_path):
    rows = [(k, f"p{k}", "graph", "P", dt.datetime(2025, 1, 1), None, json.dumps({"sketch_id": f"F{k % 50}", "x": "y" * 200})) for k in range(400)]
    spark.createDataFrame(rows, "file_no bigint, path string, kind string, patent_id string, created_at timestamp, deleted_at timestamp, body string").repartition(3).write.parquet(str(tmp_path / "t"))
    scan = compaction.scanned(spark.read.parquet(str(tmp_path / "t")))
    places = compaction.blocks_of(compaction.current_documents(scan))
    text = places._jdf.queryExecution().executedPlan().toString()
    assert all("body" not in line for line in text.splitlines() if "Exchange" in line)
    small = compaction.encoded_pieces(places, str(tmp_path / "small"), 2_000).collect()
    assert len(small) > 4
    docs, report = compaction.compact_documents(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(r["file_no"] for r in docs.collect()) == list(range(350, 400)) and sum(r["n_files"] for r in report.collect()) == 3


def files(spark, rows):
    return spark.createDataFrame(rows, "file_no bigint, path string, kind string, patent_id string, created_at timestamp, deleted_at timestamp, body string, sketch_id string")


def test_each_document_once_and_the_last(spark):
    at = lambda n: dt.datetime(2025, 1, n)
    body = lambda s, x=0: json.dumps({"sketch_id": s, "x": x})
    rows = [
        (1, "a", "graph", "P", at(1), None, body("F1"), "clash"), (2, "b", "graph", "P", at(2), None, body("F1", 2), None), (3, "c", "graph", "P", at(2), None, body("F1", 3), None),
        (4, "d", "graph", "P", at(9), at(10), body("F1"), None), (5, "e", "graph", "P", at(9), None, body("F1")[:-1], None), (6, "f", "graph", "P", at(9), None, "", None), (7, "g", "graph", "P", at(9), None, None, None),
        (8, "h", "svg", "P", at(9), None, body("F1"), None), (9, "i", "primitives", "P", at(1), None, body("F1"), None), (10, "j", "graph", "Q", at(1), None, body("F1"), None), (11, "k", "graph", "Q", at(1), None, "[1]", None),
        (12, "l", "graph", "Q", at(1), None, body(None), None),
    ]
    docs, report = compaction.compact_documents(files(spark, rows))
    assert sorted(r["file_no"] for r in docs.collect()) == [3, 9, 10, 12]
    assert report.first()["n_rows"] == 4
    assert compaction.compact_documents(files(spark, []))[0].count() == 0
