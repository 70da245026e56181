import json

from vellum.operators import nested

DOC = {"primitives": [{"type": "line", "p1": [0, 1], "p2": [2, 3], "confidence": "0.5"}, None, {"type": "polyline", "points": [[0, 0], None, [1, 2]]}, {"type": "line"}], "annotations": {"removal_mode": "leadered", "bbox": [1, 2, 3, 4], "leader_lines": {"p1": [0, 0], "p2": None}}}


def rows(spark, payloads, **how):
    df = spark.createDataFrame(list(enumerate(payloads)), "doc_no bigint, payload string")
    return nested.shred(df, **how)


def test_positions_variants_and_parents(spark):
    got = {(r["doc_no"], r["child"], r["parent_pos"], r["pos"], r["variant"]) for r in rows(spark, [json.dumps(DOC)], fields=False).collect()}
    assert got == {
        (0, "primitives", -1, 0, "line"), (0, "primitives", -1, 2, "polyline"), (0, "primitives", -1, 3, "other"), (0, "points", 2, 0, "pair"), (0, "points", 2, 2, "pair"),
        (0, "annotations", -1, 0, "leadered"), (0, "leader_lines", 0, 0, "ray"),
    }


def test_encodings_and_unreadable_payloads(spark):
    text = json.dumps(DOC)
    good = [text, json.dumps(text), json.dumps(json.dumps(text)), "\ufeff" + text, "  " + text + "\n"]
    bad = [None, "", "   ", text[:-3], text + "x", "[]", "3", "null", "{" * 10_000, json.dumps(text[:-1])]
    got = rows(spark, good + bad, fields=False).groupBy("doc_no").count().collect()
    assert {r[0]: r[1] for r in got} == {k: 7 for k in range(len(good))}


def test_numbers_are_typed_and_nan_is_null(spark):
    doc = {"primitives": [{"type": "circle", "center": [1, "2"], "radius": 3}, {"type": "circle", "center": [1, 2], "radius": 3, "confidence": float("nan")}, {"type": "circle", "center": [1, 2], "radius": 10**400, "edge_id": "7"}]}
    shredded = rows(spark, [json.dumps(doc)])
    table = nested.typed_table(shredded, "primitives", "circle").orderBy("pos").collect()
    assert [(r["pos"], r["radius"], r["confidence"], r["edge_id"]) for r in table] == [(1, 3.0, None, None), (2, None, None, 7)]
    other = nested.typed_table(shredded, "primitives", "other").collect()
    assert [r["pos"] for r in other] == [0] and json.loads(other[0]["raw"])["center"] == [1, "2"]


def test_states_of_children_decide_their_parents(spark):
    label = {"removal_mode": "leadered", "bbox": [1, 2, 3, 4]}
    doc = {
        "primitives": [{"type": "polygon", "points": p} for p in ([[0, 0], None], [None], [[0, 0], ["a", 1]], 5, None, [1, 2], {"x": 1})] + [{"type": "line", "p1": [0, 0], "p2": [1, 1], "hachure": {"pass": "c", "length": 2}}, 7, {"type": ["line"]}],
        "annotations": [label | {"leader_lines": x} for x in ([{"p1": [0, 0]}], {"p1": [0, 0], "p2": [1, 1]}, [{"p1": 3}], [], None)],
    }
    tables = nested.SubtypeTables(spark.createDataFrame([(1, json.dumps(doc))], "doc_no bigint, payload string"))
    got = {(r["child"], r["parent_pos"], r["pos"]): r["variant"] for r in tables.supertype().collect()}
    polygons = ["polygon", "pointless", "pointless", "pointless", "pointless", "polygon", "pointless"]
    assert [got["primitives", -1, k] for k in range(10)] == polygons + ["line", "other", "other"]
    assert [got["annotations", -1, k] for k in range(5)] == ["leadered", "leadered", "leadered_bare", "leadered_bare", "leadered_bare"]
    assert got["points", 2, 1] == "other" and got["points", 5, 0] == "pair" and got["points", 6, 0] == "other" and got["leader_lines", 1, 0] == "segment" and got["leader_lines", 2, 0] == "other"
    assert tables.table("primitives", "line").first()["hachure_length"] == 2.0 and tables.table("points", "other").count() == 2
    assert sum(tables.table(c, v).count() for c, kinds in nested.SUBTYPES.items() for v in kinds) == len(got)
    assert nested.state_of({"pass": "c", "length": 2}, "hachure") == "group_note" and nested.state_of([[1, 2], [3, 4]]) == "pairs"


def test_chains_and_headers(spark):
    doc = {"image_size": [30, "x"], "stroke_width": "2.5", "primitives": [{"type": "polygon", "points": [[0, 0], None, [1, 2]]}, {"type": "line"}, {"type": "polyline", "points": [3, 4]}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "x"), (3, json.dumps({"image_size": [10, 20]}))], "doc_no bigint, payload string")
    assert [(r["prim"], r["closed"], [tuple(p) for p in r["pts"]]) for r in nested.chains(df).orderBy("prim").collect()] == [(0, True, [(0, 0.0, 0.0), (2, 1.0, 2.0)]), (2, False, [(0, 3.0, 4.0)])]
    assert [tuple(r) for r in nested.headers(df).orderBy("doc_no").collect()] == [(1, None, None, 2.5, None), (3, 10.0, 20.0, None, None)]


def test_empty_table_long_document_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_no bigint, payload string, child string, doc string")
    assert nested.shred(empty).count() == 0
    long = json.dumps({"primitives": [{"type": "polyline", "points": [[k, k] for k in range(120_000)]}]})
    df = spark.createDataFrame([(1, long, "x", "y"), (1, long, "x", "y")], "doc_no bigint, payload string, child string, doc string")
    assert nested.shred(df, fields=False).count() == 2 * 120_001
