import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import capping, packing, queries


def scored(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, who string, q double, at timestamp, score string, contributor string")
    return capping.scored(df, F.col("who"), "id", "q", "at")


def test_displaced_rows_agree_with_a_full_sort(spark):
    rng = random.Random(5)
    odd = [None, float("nan"), -0.5, 1.5]
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None, ""]), rng.choice([*odd, 0.0, 1.0] + [round(rng.random(), 1)] * 6), dt.datetime(2025, 1 + rng.randrange(12), 3), "x", "y") for k in range(900)]
    good = lambda q: q is not None and 0 <= q <= 1
    want = set()
    for who in {(r[1] or "") for r in rows}:
        own = sorted((r for r in rows if (r[1] or "") == who), key=lambda r: (-(r[2] if good(r[2]) else -1.0), r[0]))
        want |= {r[0] for r in own[10:]}
    for months in (1, 6, 24):
        state = capping.capped(scored(spark, rows), 10, months)
        log = [r["row_id"] for r in state.log().collect()]
        assert len(log) == len(set(log)) and set(log) == want
        assert {r["row_id"] for r in state.kept.collect()} == {r[0] for r in rows} - want


def test_cap_of_an_empty_table_and_by_share(spark):
    state = capping.capped(scored(spark, []))
    assert state.log().count() == 0 and state.kept.count() == 0
    assert capping.share_limit(spark.range(50), 0.1) == 5 and capping.share_limit(spark.range(3), 0.1) == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_hold_everything_once_within_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 2047, rng.randrange(1, 2048), rng.randrange(1, 300)]) for _ in range(600)]
    windows = packing.packed_block(sizes, 2048)
    assert sorted(i for w in windows for i in w) == list(range(600))
    assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)
    assert len(windows) <= 1.25 * sum(sizes) / 2048 + 1
    assert packing.packed_block([0, 0], 10) == [[0, 1]] and packing.differencing([], 3) == []


def test_differencing_balances():
    rng = random.Random(4)
    sizes = [rng.randrange(20, 400) for _ in range(400)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 40)]
    assert max(sums) - min(sums) <= 12


def test_containers(spark):
    text = "The rocker arm 57 is fed through the flange. " * 30
    rows = [(k, text[: 40 + 37 * (k % 30)], "x") for k in range(300)] + [(900, None, "x"), (901, "", "x"), (902, text * 40, "x"), (902, text * 40, "x"), (903, "ก" * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc string")
    vocabulary = queries.VOCABULARY
    boxes = packing.packed(df, vocabulary, block_items=100).collect()
    assert all(b["n_tokens"] == sum(i["n_tokens"] for i in b["items"]) <= 2048 and b["n_items"] == len(b["items"]) for b in boxes)
    assert len({b["container_id"] for b in boxes}) == len(boxes)
    seen = [i["doc"] for b in boxes for i in b["items"]]
    assert set(seen) == {r[0] for r in rows} and all(seen.count(k) == 1 for k in range(300)) and seen.count(902) == 2 * len({i["piece"] for b in boxes for i in b["items"] if i["doc"] == 902})
    encode = packing.tokenizer(vocabulary).encode_ordinary
    assert sum(b["n_tokens"] for b in boxes) == sum(len(encode(r[1] or "")) for r in rows)
    parts = sorted((i["start"], i["n_tokens"]) for b in boxes for i in b["items"] if i["doc"] == 903)
    assert [a for a, _ in parts] == list(range(0, len(encode(rows[-1][1])), 2048)) and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert packing.packed(df.limit(0), vocabulary).count() == 0


def test_containers_are_nearly_full():
    """Blocks as the query makes them, of sizes like those of texts: at most two windows in a hundred more than the least possible."""
    rng = random.Random(9)
    sizes = [min(2_047, int(rng.lognormvariate(5.0, 0.8)) + 1) for _ in range(2_000)]
    windows = packing.packed_block(sizes, 2_048)
    assert len(windows) <= 1.02 * -(-sum(sizes) // 2_048) and max(sum(sizes[i] for i in w) for w in windows) <= 2_048
