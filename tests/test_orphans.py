import datetime as dt
import random

from pyspark.sql import functions as F

from vellum.functions.keys import leading_patent, plain_patent, run_path, utc_month
from vellum.operators import orphans


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def brute(refs, parents):
    out = set()
    for no, key, at in refs:
        own = [p for p in parents if p[0] == key]
        live = [p[1] for p in own if p[2] is None]
        state = "missing" if not own else "deleted" if not live else "late" if min(live) > at else None
        if state:
            out.add((no, state))
    return out


def states(spark, refs, parents, months):
    r = spark.createDataFrame(refs, "load_no bigint, k string, loaded_at timestamp")
    p = spark.createDataFrame(parents, "k string, since timestamp, until timestamp")
    return orphans.replay(orphans.references(r, "t", "f", "s", F.col("k")), orphans.parent_events(p, "s", F.col("k"), "since", "until"), months)


def test_replay_agrees_with_brute_force_for_any_batches(spark):
    rng = random.Random(1)
    refs = [(n, f"k{rng.randrange(30)}", day(rng.randrange(400))) for n in range(200)] + [(500, "k1", day(3))] * 1
    parents = [(f"k{rng.randrange(25)}", day(rng.randrange(400)), None if rng.random() < 0.5 else day(rng.randrange(400, 600))) for _ in range(60)]
    want = brute(refs, parents)
    assert {s for _, s in want} == {"missing", "deleted", "late"}
    for months in (3, 24):
        last = states(spark, refs, parents, months)[-1][1]
        assert {(r["load_no"], r["ref_state"]) for r in last.orphans().collect()} == want
        assert sum(r["n_refs"] for r in last.snapshot().collect()) == len(want)


def test_a_batch_writes_what_it_touches(spark):
    refs = [(n, f"k{n}", day(1)) for n in range(2_000)]
    first = states(spark, refs, [(f"k{n}", day(0), None) for n in range(1_000)], 1)[-1][1]
    p = spark.createDataFrame([(f"k{n}", day(100), None) for n in range(990, 1_010)], "k string, since timestamp, until timestamp")
    events = orphans.parent_events(p, "s", F.col("k"), "since", "until").drop("at")
    none = spark.createDataFrame([], "load_no bigint, k string, loaded_at timestamp")
    later = first.advance(orphans.references(none, "t", "f", "s", F.col("k")), events)
    assert later.index[-1].count() == 20 and later.refs[-1].count() == 0 and later.changes[-1].count() == 10 and later.index[0] is first.index[0]
    assert first.orphans().count() == 1_000 and {(r["ref_state"], r["count"]) for r in later.orphans().groupBy("ref_state").count().collect()} == {("missing", 990), ("late", 10)}


def test_folding_changes_nothing(spark, monkeypatch):
    rng = random.Random(2)
    refs = [(n % 90, f"k{rng.randrange(20)}", day(rng.randrange(300))) for n in range(100)]
    parents = [(f"k{rng.randrange(18)}", day(rng.randrange(300)), None if rng.random() < 0.5 else day(rng.randrange(300, 360))) for _ in range(30)]
    monkeypatch.setattr(orphans, "PARTS", 2)
    folded = states(spark, refs, parents, 2)
    assert len(folded[-1][1].index) <= 2
    got = sorted((r["load_no"], r["ref_state"]) for r in folded[-1][1].orphans().collect())
    assert got == sorted((no, s) for n, ref in enumerate(refs) for no, s in brute([ref], parents))


def test_arrivals_resolve_and_deletions_reopen(spark):
    steps = states(spark, [(1, "a", day(40))], [("a", day(100), day(200)), ("b", day(1), None)], 1)
    seen = [[r["ref_state"] for r in s.orphans().collect()] for _, s in steps]
    assert seen[1] == ["missing"] and ["late"] in seen and seen[-1] == ["deleted"]


def test_nulls_and_empty_tables(spark):
    assert states(spark, [], [], 6)[-1][1].orphans().count() == 0
    last = states(spark, [(1, None, day(1)), (2, "a", None), (3, "c", day(2))], [("a", None, None), (None, day(1), None)], 6)[-1][1]
    assert [(r["load_no"], r["ref_state"]) for r in last.orphans().collect()] == [(3, "missing")]


def test_key_spellings(spark):
    paths = ["runs/corpus_gated/A/g/x.json", " ./runs/corpus_gated/A//g/./x.json ", "D:\\b\\runs\\corpus_gated\\A\\g\\x.json", "/srv/runs/corpus_gated/A/v/../g/x.json", "A/g/x.json"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(run_path(F.col("p"))).collect()
    assert {r[0] for r in got} == {"A/g/x.json"}
    other = spark.createDataFrame([("runs/corpus_gated/A/g/X.json",), ("",), ("  ",), (None,)], "p string").select(run_path(F.col("p"))).collect()
    assert [r[0] for r in other] == ["A/g/X.json", None, None, None]
    for spelling in ("EP1234567", "ep-1234567", "EP 1 234 567 B1", "Ep1234.567A", " EP1234567A2 "):
        assert spark.range(1).select(plain_patent(F.lit(spelling))).first()[0] == "EP1234567"
    for sketch, want in {"EP-1234567_F0001": "EP1234567", "us7654321b2-A0001": "US7654321", "F0001": None, "SHEET1_A0004": None, "EP12345678_F1": None, "REV2_F0001": None}.items():
        assert spark.range(1).select(leading_patent(F.lit(sketch))).first()[0] == want
    assert spark.range(1).select(utc_month(F.timestamp_seconds(F.lit(1735689599)))).first()[0] == "2024-12"
