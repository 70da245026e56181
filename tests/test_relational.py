import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import aggregates as agg
from vellum.operators import labelling
from vellum.operators import geometry as geo
from vellum.operators import relational as rel
from vellum.operators.components import components
from vellum.operators.rules import PAGE_CLASSES, PAGE_ELSE, Step, first_match, stage_gate


def test_first_match_keeps_order_and_ignores_null(spark):
    chain = first_match([Step("a > 1", "big"), Step("b = 'x'", "x")], "none")
    rows = spark.createDataFrame([(2.0, "x"), (1.0, "x"), (None, "x"), (None, None)], "a double, b string").select(chain).collect()
    assert [r[0] for r in rows] == ["big", "x", "x", "none"]
    assert len(PAGE_CLASSES) == 22 and PAGE_ELSE.startswith("drawing") and len(stage_gate(0, 0)[2].when) < len(stage_gate()[2].when)


@pytest.mark.parametrize("density,reason", [(0.22, "too_dense"), (0.2199, "long_engineering"), (0.007, "long_engineering")])
def test_page_classes_at_the_threshold(spark, density, reason):
    cols = {"letter_code": "F", "skel_n_cc": 5, "skel_tiny_cc_frac": 0.1, "text_density": density, "large_cc_frac": 0.3, "n_cc": 50, "long_lines": 5, "line_hv_ratio": 0.5, "line_diag_ratio": 0.5, "skel_median_cc_area": 5.0}
    got = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(first_match(PAGE_CLASSES, PAGE_ELSE)).first()[0]
    assert reason in got


def test_keep_last_upsert_and_unseen(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 2), (None, 5)], "k string, n int")
    assert {tuple(r) for r in rel.keep_last(df, ["k"], "n").collect()} == {("a", 3), (None, 5)}
    new = spark.createDataFrame([("a", 9, "z")], "k string, n int, extra string")
    assert {tuple(r) for r in rel.upsert(df, new, ["k"]).collect()} == {(None, 2, None), (None, 5, None), ("a", 9, "z")}
    assert rel.unseen(df, new, ["k"]).count() == 2


def test_exact_ranks_tiles_and_percentiles(spark):
    values = [random.Random(2).random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    rows, n = rel.ranked(df, "v")
    assert n == 500 and [r["v"] for r in rows.orderBy("rank").collect()] == sorted(values)
    tiled = rows.select(rel.tile(F.col("rank"), n, 3).alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in tiled] == [167, 167, 166]
    got = {r["percent"]: r["value"] for r in agg.index_percentile(df, "v", [0, 50, 95]).collect()}
    assert got == {p: sorted(values)[500 * p // 100] for p in (0, 50, 95)}
    assert rel.ranked(df.limit(0), "v")[1] == 0


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_components_by_either_way(spark, one_task):
    rng = random.Random(3)
    edges = [(f"{rng.randrange(200):03d}", f"{rng.randrange(200):03d}") for _ in range(130)] + [("x1", "x2"), ("x2", "x3"), ("x2", "x3"), ("y", "y"), (None, "z")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src string, dst string"), one_task=one_task).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "src string, dst string"), one_task=one_task).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_joins_give_what_plain_ones_give(spark, how):
    rng = random.Random(6)
    rows = spark.createDataFrame([(k, rng.choice(["hot"] * 5 + [None, "x", "y"]) if k % 2 else f"k{k}", [rng.randrange(2)]) for k in range(3_000)], "n int, k string, a array<int>")
    keyed = spark.createDataFrame([("hot", [0], 1), ("hot", [1], 2), ("x", [0], 3), ("k4", [1], 4), (None, [1], 5)], "k string, a array<int>, v int")
    rows = rows.withColumns({"m": F.create_map(F.lit("x"), F.col("n")), "odd.name": F.lit(1)})
    hot = rel.hot_keys(rows, ["k", "a"])
    assert {(r["k"], r["a"][0]) for r in hot.collect()} >= {("hot", 0), ("hot", 1)} and hot.count() < rel.HOT_SHARE
    got, want = rel.salted_join(rows, keyed, ["k", "a"], hot, how), rows.join(keyed, ["k", "a"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = rel.salted_join(rows, keyed, ["k", "a"], hot, how).where("k = 'hot' and a[0] = 0").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spread > 1


def test_nearest_and_chamfer_against_brute_force(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 100, (40, 2)), rng.uniform(0, 100, (30, 2))
    left = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(a)], "g int, i int, x double, y double")
    right = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(b)], "g int, j int, x double, y double")
    gaps = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    got = {r["i"]: (r["j"], round(r["distance"], 9)) for r in rel.nearest(left, right, ["g"], "i", "j", 15.0).collect()}
    assert got == {i: (int(g.argmin()), round(float(g.min()), 9)) for i, g in enumerate(gaps) if g.min() <= 15}
    assert abs(geo.chamfer(left, right, ["g"], 2.0).first()["mean"] - gaps.min(axis=1).mean()) < 1e-9


def test_fits_of_known_shapes(spark):
    t = np.linspace(0, 1, 40)
    line = [(1, k, 10 + 30 * x, 5 + 40 * x) for k, x in enumerate(t)]
    arc = [(2, k, 50 + 20 * np.cos(x * 4), 60 + 20 * np.sin(x * 4)) for k, x in enumerate(t)]
    rows = [(g, [(k, float(x), float(y)) for _, k, x, y in points]) for g, points in ((1, line), (2, arc), (3, line[:1]), (4, [(4, k, 5.0, 5.0) for k in range(3)]))]
    df = spark.createDataFrame(rows, "g int, pts array<struct<k:int,x:double,y:double>>")
    fits = {r["g"]: r for r in geo.line_fits(df).collect()}
    assert abs(fits[1]["angle"] - np.degrees(np.arctan2(40, 30))) < 1e-9 and fits[1]["confidence"] > 0.999 and fits[2]["confidence"] < 0.3
    circles = {r["g"]: r for r in geo.circle_fits(df).collect()}
    assert list(circles) == [2] and abs(circles[2]["radius"] - 20) < 1e-6 and abs(circles[2]["cx"] - 50) < 1e-6
    assert {r["g"]: r["type"] for r in geo.fit_choice(df).collect()} == {1: "line", 2: "arc", 3: "polyline", 4: "line"}
    span = geo.arc_spans(df).first()
    assert abs(span["span"] - np.degrees(4)) < 1e-6 and abs(span["start"]) < 1e-6
    ring = spark.createDataFrame([(1, [(k, float(50 + 9 * np.cos(a)), float(50 + 9 * np.sin(a))) for k, a in enumerate(np.linspace(0, 6.2, 30).tolist())]), (2, [(0, 0.0, 0.0), (1, 20.0, 0.0), (2, 20.0, 1.0), (3, 0.0, 1.0), (4, 10.0, 0.5), (5, 10.0, 0.4), (6, 10.0, 0.5), (7, 0.0, 0.0)])], "g int, pts array<struct<k:int,x:double,y:double>>")
    assert {r["g"]: (r["round"], r["noise"]) for r in geo.circular(ring).collect()} == {1: (True, False), 2: (False, True)}
    assert {r["g"]: r["type"] for r in geo.closed_choice(ring).collect()}[1] == "circle"


def test_distances_of_boxes_and_segments(spark):
    rows = [(0.0, 0.0, 10.0, 10.0, "through"), (-5.0, 3.0, -1.0, 3.0, "end"), (0.0, -20.0, 20.0, -4.0, "corner"), (3.0, -9.0, 3.0, 99.0, "across"), (2.0, 2.0, 2.0, 2.0, "inside"), (30.0, 0.0, 30.0, 0.0, "point")]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, name string")
    box = {"x": F.lit(1.0), "y": F.lit(1.0), "w": F.lit(4.0), "h": F.lit(4.0)}.__getitem__
    got = {r["name"]: r["d"] for r in df.select("name", geo.segment_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), box).alias("d")).collect()}

    def brute(x1, y1, x2, y2):
        t = np.linspace(0, 1, 20_001)
        x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        return float(np.hypot(np.maximum(0, np.maximum(1 - x, x - 5)), np.maximum(0, np.maximum(1 - y, y - 5))).min())

    assert all(abs(got[n] - brute(*r)) < 1e-3 for *r, n in rows), got


def test_leaders_and_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    boxes = [(1, k, float(x), float(y), 20.0, 12.0, 60.0) for k, (x, y) in enumerate(rng.uniform(0, 1500, (40, 2)))]
    lines = [(1, k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 1500, (60, 4)))]
    b = spark.createDataFrame(boxes, "g int, pos int, x double, y double, w double, h double, area double")
    s = spark.createDataFrame(lines, "g int, pos int, x1 double, y1 double, x2 double, y2 double").withColumns({"length": F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")), "angle": F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(180.0))})
    t = np.linspace(0, 1, 4001)
    want = {}
    for _, k, x, y, w, h, _ in boxes:
        away = lambda px, py: np.hypot(np.maximum(0, np.maximum(x - px, px - x - w)), np.maximum(0, np.maximum(y - py, py - y - h)))  # noqa: B023, E731
        scores = []
        for _, n, x1, y1, x2, y2 in lines:
            end, side = min(away(x1, y1), away(x2, y2)), away(x1 + t * (x2 - x1), y1 + t * (y2 - y1)).min()
            if end <= 90 or side <= 40:
                scores.append(((end if end <= 90 else side) + 0.015 * np.hypot(x2 - x1, y2 - y1), n))
        want[k] = [n for _, n in sorted(scores)[:2]]
    got = {}
    for r in labelling.leaders(b.withColumnRenamed("pos", "label"), s, ["g"], "label", "pos", 90.0, 40.0, 0.015, 8.0, 8.0).orderBy("place").collect():
        got.setdefault(r["label"], []).append(r["pos"])
    assert sum(got.get(k) == v for k, v in want.items() if v) >= 0.95 * sum(bool(v) for v in want.values()) and set(got) == {k for k, v in want.items() if v}
    root = list(range(40))
    for i, (_, _, x, y, w, h, _) in enumerate(boxes):
        for j, (_, _, u, v, _, _, _) in enumerate(boxes):
            if i < j and max(0, abs(x - u) - w) <= 60 and abs(x - u) < 220 and (abs(y - v) <= 18 or max(0, h - abs(y - v)) / h >= 0.35):
                a, c = sorted((root[i], root[j]))
                root = [a if q == c else q for q in root]
    assert {r["root"]: r["n"] for r in labelling.text_clusters(b, ["g"], "pos", 60.0, 18.0, 0.75, 220.0).collect()} == {r: root.count(r) for r in set(root)}


def test_scores_are_null_where_undefined(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (2, 1, 0)], "tp bigint, fp bigint, fn bigint")
    got = [(r["precision"], r["recall"], r["f1"]) for r in agg.scores(df).collect()]
    assert got[0] == (None, None, None) and got[1] == (0.0, 0.0, None) and abs(got[2][2] - 0.8) < 1e-12
