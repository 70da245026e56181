import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import splits


def table(spark, rows):
    return spark.createDataFrame(rows, "load_no bigint, patent_id string, sketch_id string, status string, entity string, split_x string")


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        p = f"EP{rng.randrange(1, 400) if rng.random() > 0.33 else 1:07d}"
        other = f"us{rng.randrange(1, 200):07d}b1"
        rows.append((k, p if rng.random() > 0.1 else p.lower(), f"{other}_F0001" if rng.random() < 0.02 else "F0001", rng.choice(["ok", "ok", "ok", "late", "bad", None]), "e", "s"))
    return rows


def test_groups_stay_together_and_shares_hold(spark):
    df = splits.patent_groups(table(spark, made(6000)))
    for how in ({}, {"bucket_groups": 40}, {"large": 3}):
        rows = splits.split_rows(df, "status", **how)
        assert rows.count() == 6000 and rows.where("split is null").count() == 0
        assert rows.groupBy("group_key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
        share = {r["split"]: r["count"] / 6000 for r in rows.groupBy("split").count().collect()}
        assert abs(share["train"] - 0.8) < 0.04 and abs(share["test"] - 0.1) < 0.03, share


def test_ties_run_over_any_number_of_steps(spark):
    rows = [(1, "EP0000005", "F1", "ok", None, None), (2, "ep-0000005", "US0000003_F1", "ok", None, None), (3, "WO0000009", "us 0000003a1-F2", "ok", None, None), (4, "WO0000009", "JP0000001_F2", "ok", None, None), (5, "JP0000007", "F1", "ok", None, None), (6, "JP0000007", "F1", None, None, None)]
    got = splits.mixed_groups(splits.patent_groups(table(spark, rows)), "patent_id")
    assert {(r["load_no"], r["group_key"]) for r in got.collect()} == {(k, "EP0000005") for k in (1, 2, 3, 4)}
    assert "entity" in got.columns


def test_nulls_and_empty_tables(spark):
    df = splits.patent_groups(table(spark, [(1, None, None, None, None, None), (2, None, "EP0000001_F", "ok", None, None)]))
    assert splits.split_rows(df, "status").where("split is not null").count() == 2
    assert splits.split_rows(splits.patent_groups(table(spark, [])), "status").count() == 0


def test_placement_gives_rare_labels_their_share():
    groups = [(k, {"a": 10}) for k in range(80)] + [(100 + k, {"a": 5, "rare": 1}) for k in range(20)]
    totals = {"a": 900, "rare": 20}
    desired = [{x: w * n for x, n in totals.items()} for w in splits.SHARES]
    placed = splits.place(groups, desired, [w * 920 for w in splits.SHARES])
    rare = [placed[100 + k] for k in range(20)]
    assert [rare.count(s) for s in range(3)] == [16, 2, 2]


def test_rare_labels_get_their_shares_over_many_buckets(spark):
    rows = [(k, f"EP{k:07d}", "F1", "rare" if k % 100 == 0 else "odd" if k % 40 == 1 else "ok", None, None) for k in range(4_000)]
    got = splits.split_rows(splits.patent_groups(table(spark, rows)), "status", bucket_groups=100)
    count = {(r["status"], r["split"]): r["count"] for r in got.groupBy("status", "split").count().collect()}
    assert [count["rare", s] for s in splits.SPLITS] == [32, 4, 4] and [count["odd", s] for s in splits.SPLITS] == [80, 10, 10]


def test_many_labels(spark):
    rows = [(k, f"EP{k:07d}", "F1", f"label {k % 300}", None, None) for k in range(3_000)]
    df = splits.patent_groups(table(spark, rows))
    got = {(r["status"], r["split"]): r["count"] for r in splits.split_rows(df, "status").groupBy("status", "split").count().collect()}
    assert all([got[f"label {k}", s] for s in splits.SPLITS] == [8, 1, 1] for k in range(300))
    with pytest.raises(ValueError, match="labels"):
        splits.group_splits(df, "status", most_labels=299)
