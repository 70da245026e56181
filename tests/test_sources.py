import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import learning, nested, raster
from vellum.operators.rules import first_match, steps_of
from vellum.plans import batch
from vellum.sources import readers, sinks
from vellum.sources import vector_text as vec
from vellum.sources.synthetic import synthetic_strokes
from vellum.sources.tiff import MODES, RUNS


def png(image, filters):
    h, w = image.shape
    raw, above = b"", np.zeros(w, int)
    for y in range(h):
        row, f = image[y].astype(int), filters[y % len(filters)]
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [np.zeros(w, int), left, above, (left + above) // 2, paeth][f]
        raw += bytes([f]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_rasters_of_two_formats_and_broken_files(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (9, 13)).astype(np.uint8)
    assert (readers.decoded(png(image, [0, 1, 2, 3, 4])) == image).all()
    folder = tmp_path / "EP1" / "x"
    folder.mkdir(parents=True)
    (folder / "a.png").write_bytes(png(image, [4]))
    (folder / "b.pgm").write_bytes(b"P5\n13 9\n255\n" + image.tobytes())
    for name, data in {"c.png": b"\x89PNG\r\n\x1a\nxx", "d.pgm": b"P5 99 99 255\n12", "e.bin": b"", "f.png": png(image, [0])[:60]}.items():
        (folder / name).write_bytes(data)
    got = {r["path"][-5:]: r for r in readers.rasters(spark, str(tmp_path)).collect()}
    assert got["a.png"]["gray"] == got["b.pgm"]["gray"] == image.tobytes() and got["a.png"]["height"] == 9
    assert all(got[n]["gray"] is None for n in ("c.png", "d.pgm", "f.png")) and "e.bin" not in got


def tiff(image, packing=1, depth=8, rows=None, data=None, dark_zero=True, order="<", predictor=1):
    """A grey TIFF file with one image; ``data`` are its strips if they are coded."""
    import struct

    h, w = image.shape[:2]
    rows = rows or h
    strips = data or [(np.packbits(image[k : k + rows] > 0, axis=1) if depth == 1 else image[k : k + rows]).tobytes() for k in range(0, h, rows)]
    at, body, places = 8, b"", []
    for s in strips:
        places.append(at + len(body))
        body += s
    n = len(strips)
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [depth]), (259, 3, [packing]), (262, 3, [int(dark_zero)]), (273, 4, places), (277, 3, [image.shape[2] if image.ndim == 3 else 1]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor])]
    ifd, extra, start = b"", b"", at + len(body)
    far = start + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            raw, extra = struct.pack(order + "I", far + len(extra)), extra + raw
        ifd += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", start) + body + struct.pack(order + "H", len(entries)) + ifd + bytes(4) + extra


def coded_group_4(image):
    """Bits of a black-and-white image in group 4 coding, by the changes of each line."""
    codes = [{n: c for c, n in t.items()} for t in RUNS]
    modes = {v: c for c, v in MODES.items()}

    def run(n, black):
        out = ""
        while n > 2560:
            out, n = out + codes[black][2560], n - 2560
        return out + (codes[black][n // 64 * 64] if n > 63 else "") + codes[black][n % 64]

    bits, above = "", []
    w = image.shape[1]
    for line in image:
        change = [x for x in range(w) if bool(line[x]) != (bool(line[x - 1]) if x else False)]
        at, black = -1, 0
        while at < w:
            a = next((c for c in change if c > at and (change.index(c) % 2 == black)), w)
            b1 = next((k for k, c in enumerate(above) if c > at and k % 2 == black), len(above))
            b2 = above[b1 + 1] if b1 + 1 < len(above) else w
            b1 = above[b1] if b1 < len(above) else w
            if b2 < a:
                bits, at = bits + modes["pass"], b2
            elif abs(a - b1) <= 3:
                bits, at, black = bits + modes[a - b1], a, 1 - black
            else:
                later = next((c for c in change if c > a), w)
                bits, at = bits + modes["across"] + run(a - max(at, 0), black) + run(later - a, 1 - black), later
        above = change
    bits += "000000000001" * 2
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def coded_lzw(data):
    table, bits, wide, last = {bytes([i]): i for i in range(256)}, f"{256:09b}", 9, b""
    size = 258
    for b in data:
        if last + bytes([b]) in table:
            last += bytes([b])
            continue
        bits += f"{table[last]:0{wide}b}"
        table[last + bytes([b])] = size
        size += 1
        wide = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        last = bytes([b])
        assert size < 4000
    bits += f"{table[last]:0{wide}b}"
    return bits


def test_tiff_files_of_all_kinds():
    rng = np.random.default_rng(2)
    gray = rng.integers(0, 256, (21, 37)).astype(np.uint8)
    assert (readers.decoded(tiff(gray)) == gray).all() and (readers.decoded(tiff(gray, rows=5, order=">")) == gray).all()
    assert (readers.decoded(tiff(gray, dark_zero=False)) == 255 - gray).all()
    assert (readers.decoded(tiff(gray, 8, data=[zlib.compress(gray.tobytes())])) == gray).all()
    steps = np.diff(gray, axis=1, prepend=np.uint8(0)).astype(np.uint8)
    assert (readers.decoded(tiff(gray, 8, data=[zlib.compress(steps.tobytes())], predictor=2)) == gray).all()
    packed = b"".join(bytes([36]) + row.tobytes() for row in gray)
    assert (readers.decoded(tiff(gray, 32773, data=[packed])) == gray).all() and readers.decoded(tiff(np.full((2, 100), 7, np.uint8), 32773, data=[bytes([157, 7, 128, 157, 7])])).tolist() == [[7] * 100] * 2
    bits = coded_lzw(gray.tobytes())
    assert (readers.decoded(tiff(gray, 5, data=[bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))])) == gray).all()
    page = np.zeros((60, 3_000), bool)
    page[5:40, 100:160] = page[20, 10:2_990] = page[41:44, 700:2_000] = True
    page |= rng.random(page.shape) < 0.01
    want = np.where(page, 0, 255)
    assert (readers.decoded(tiff(page, 4, 1, data=[coded_group_4(page)], dark_zero=False)) == want).all()
    assert (readers.decoded(tiff(page, 4, 1, rows=17, data=[coded_group_4(page[k : k + 17]) for k in range(0, 60, 17)], dark_zero=False)) == want).all()
    assert (readers.decoded(tiff(~page, 1, 1)) == want).all()
    rgb = rng.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    assert (readers.decoded(tiff(rgb)) == np.round(rgb @ np.array([0.299, 0.587, 0.114]))).all()
    good = tiff(gray)
    for bad in (good[:40], good[:-60], b"II*\0", tiff(gray, 7), tiff(gray, 8, data=[b"xx"]), tiff(page, 4, 1, data=[b"\x00\x0f"]) [:50]):
        assert readers.decoded(bad) is None


def test_pages_are_measured_and_broken_ones_labelled(spark, tmp_path):
    page = np.zeros((400, 600), bool)
    page[100:104, 50:550] = page[50:350, 300:304] = True
    (tmp_path / "EP1").mkdir()
    (tmp_path / "EP1" / "EP1_F0001.tif").write_bytes(tiff(page, 4, 1, data=[coded_group_4(page)], dark_zero=False))
    (tmp_path / "EP1" / "EP1_F0002.tif").write_bytes(b"II*\0broken")
    got = {r["path"][-9:]: r for r in readers.page_rows(spark, str(tmp_path)).collect()}
    assert got["F0001.tif"]["label"] is None and got["F0001.tif"]["n_cc"] == 1 and got["F0001.tif"]["line_hv_ratio"] == 1.0 and got["F0001.tif"]["long_lines"] >= 2
    assert got["F0002.tif"]["label"] == "error" and got["F0002.tif"]["n_cc"] is None


def test_numbered_images_label_packs_and_gold(spark, tmp_path):
    import io

    (tmp_path / "n").mkdir()
    for n in ("10", "9", "x"):
        (tmp_path / "n" / f"{n}.png").write_bytes(png(np.full((2, 3), int(n) if n != "x" else 0, np.uint8), [0]))
    assert [(r["number"], r["gray"][0]) for r in readers.numbered_images(spark, str(tmp_path / "n")).collect()] == [(9, 9), (10, 10)]
    (tmp_path / "l" / "train" / "a").mkdir(parents=True)
    out = io.BytesIO()
    np.savez(out, skeleton=np.zeros((4, 4), np.uint8), kps=np.array([[1, 2, 0], [3, 3, 2]], np.int32), meta=np.array("{}"))
    (tmp_path / "l" / "train" / "a" / "p.npz").write_bytes(out.getvalue())
    (tmp_path / "l" / "train" / "q.npz").write_bytes(b"no pack")
    assert sorted(tuple(r)[1:] for r in readers.label_packs(spark, str(tmp_path / "l"), "train").collect()) == [(1, 2, "endpoint"), (3, 3, "corner")]
    (tmp_path / "g").mkdir()
    for n, seen in enumerate((True, False, None)):
        (tmp_path / "g" / f"{n}.json").write_text(json.dumps({"sketch_id": f"F{n}", "reviewed": seen, "keypoints": [{"x": 1, "y": 2, "type": "corner"}]}))
    assert [(r["sketch_id"], r["x"], r["type"]) for r in readers.gold_labels(spark, str(tmp_path / "g")).collect()] == [("F0", 1, "corner")]


def test_settings(tmp_path):
    from vellum.plans.batch import Limits
    from vellum.sources import config

    (tmp_path / "c.yaml").write_text("stage1:\n  weights: models/a.pt\n  quality: 0.5\nn: 3\n")
    tree = config.settings(str(tmp_path / "c.yaml"))
    assert tree["stage1"] == {"weights": str(tmp_path / "models/a.pt"), "quality": 0.5} and tree["n"] == 3
    (tmp_path / "e.yaml").write_text("")
    assert config.settings(str(tmp_path / "e.yaml")) == {}
    assert config.applied(Limits(), {"quality": 0.5}).quality == 0.5
    with pytest.raises(ValueError, match="qality"):
        config.applied(Limits(), {"qality": 0.5})


def test_svg_is_drawn(spark):
    text = '<svg viewBox="0 0 100 100"><line x1="10" y1="50" x2="90" y2="50"/><polygon points="10,10 30,10 30,30"/><circle cx="70" cy="20" r="10"/><path d="M 10 90 L 90 90"/><line x1="a"/></svg>'
    mask = readers.svg_mask(text, 200)
    assert mask[100, 100] and mask[20, 40] and mask[40, 40 + 20] and mask[40, 160] and not mask[40, 140] and mask[180, 100] and readers.svg_mask("", 10).sum() == 0
    counts = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(readers.path_count(F.col("t"))).collect()
    assert [r[0] for r in counts] == [1, 0, -1]


def test_tables_documents_and_samples(spark, tmp_path):
    from vellum.operators import relational as rel

    for _ in range(2):
        sinks.ensure_table(spark, "vellum_t", {"a": "int"}, str(tmp_path / "t"))
    sinks.append_rows(spark.createDataFrame([(1,)], "a int"), "vellum_t")
    sinks.ensure_table(spark, "vellum_t", {"a": "int", "B": "string"})
    sinks.append_rows(spark.createDataFrame([("x", 2, 9)], "b string, a int, c int"), "vellum_t")
    assert sorted(map(tuple, spark.table("vellum_t").collect()), key=str) == [(1, None), (2, "x")]
    spark.sql("DROP TABLE vellum_t")
    docs = sinks.json_documents(spark.createDataFrame([(1, float("nan"), None), (2, 0.5, "z")], "k int, x double, t string"), "k").orderBy("k").collect()
    assert [json.loads(r["body"]) for r in docs] == [{"x": None, "t": None}, {"x": 0.5, "t": "z"}]
    ids = spark.range(10).selectExpr("id as k")
    assert [r["k"] for r in rel.limited_first(ids, ["k"], 4, (ids.where("k in (1, 9)"), ["k"])).orderBy("k").collect()] == [0, 2, 3]
    assert rel.sampled_ids(ids.union(ids), "k", 3, 42).count() == 6


def test_corpus_walk(spark, tmp_path):
    for name in ("EP1/EP1_F0002.tif", "EP1/other_A0001.TIFF", "EP2/EP2_x.tif", "EP2/skip.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    got = {(r["patent_id"], r["sketch_id"], r["letter_code"]) for r in readers.corpus_walk(spark, str(tmp_path)).collect()}
    assert got == {("EP1", "F0002", "F"), ("EP1", "other_A0001", "A"), ("EP2", "x", "")}


def test_texts_become_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ("1.9", "-1.9", " 7 ", "", None, "nan", "inf", "x", "1e99")], "t string")
    got = rows.select(readers.number("t", -1.0).alias("n"), readers.whole("t", -1).alias("w")).collect()
    assert [r["w"] for r in got] == [1, -1, 7, -1, -1, -1, -1, -1, -1] and got[6]["n"] == float("inf") and got[5]["n"] == -1.0


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "b", c\nd ', None), (2, "", 1.5), (2, "", 1.5)], "n int, t string, x double")
    sinks.write_csv(df, str(tmp_path / "c"), ["n", "t", "x", "gone"], one_file=True)
    back = readers.text_table(spark, str(tmp_path / "c"), ["n", "t", "x", "gone"])
    assert sorted(r["n"] for r in back.collect()) == ["1", "2", "2"] and {r["gone"] for r in back.collect()} == {None}
    sinks.write_json_lines(df, str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert all(list(x) == ["n", "t", "x"] for x in lines) and len(lines) == 3
    sinks.write_partitioned(df.withColumn("patent_id", F.lit("EP1")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    moves = sinks.quarantine_moves(spark.createDataFrame([("/a/b/x.tif", "EP1")], "path string, patent string"), "/q/").first()
    assert tuple(moves) == ("/a/b/x.tif", "/q/EP1/x.tif")


def test_documents_and_split_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sketch_id": "F1", "image_size": [1, 2], "primitives": []}))
    (tmp_path / "b.json").write_text(json.dumps({"sketch_id": "F2"}))
    good, bad = readers.documents(spark, str(tmp_path), "sketch_id string, image_size array<int>, primitives array<string>", ["sketch_id", "image_size", "primitives"])
    assert [r["sketch_id"] for r in good.collect()] == ["F1"] and bad.first()["lacking"] == ["image_size", "primitives"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "split.json").write_text(json.dumps({"train": ["0078/00780135"], "test": ["1/2", "1/3"]}))
    got = {tuple(r) for r in readers.split_file(spark, str(tmp_path / "s" / "split.json")).collect()}
    assert got == {("train", "0078", "00780135"), ("test", "1", "2"), ("test", "1", "3")}


@pytest.mark.parametrize("d,want", [("M 0 0 1 1 L 2 0 Z", [[(0, 0), (1, 1), (2, 0), (0, 0)]]), ("M0,0L5,5M9 9L8 8", [[(0, 0), (5, 5)], [(9, 9), (8, 8)]]), ("", []), ("L 1", []), ("C 1 1 1 1 1 1", [])])
def test_paths(d, want):
    assert readers.flattened(d) == want


def test_cubics_and_svg_table(spark):
    chain = readers.flattened("M 0 0 C 0 10 10 10 10 0")[0]
    assert len(chain) == 17 and chain[8] == (5.0, 7.5) and chain[-1] == (10.0, 0.0)
    svg = '<svg><path d="M 0 0 L 3 4"/><path stroke="x" d="M 1 1 L 2 2"/></svg>'
    got = readers.svg_chains(spark.createDataFrame([(1, svg), (2, "<svg/>"), (3, None)], "k int, t string"), "k", "t")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 3.0, 4.0), (1, 1, 0, 1.0, 1.0), (1, 1, 1, 2.0, 2.0)]


def test_export_values(spark):
    primitives = [{"type": "arc", "center": [50, 500], "radius": 10, "start_angle": 10, "end_angle": 50}, {"type": "line", "p1": [0, 500], "p2": [1, 2], "style": "hidden"}, {"type": "circle", "center": [100, 500], "radius": 20, "style": "odd"}]
    p = nested.shred(spark.createDataFrame([(1, json.dumps({"primitives": primitives}))], "doc_no bigint, payload string"))
    p = p.withColumns({"pts": F.lit(None).cast("array<struct<k:int,x:double,y:double>>"), "height": F.lit(600.0), "stroke_width": F.lit(None).cast("double")})
    dxf = {r["variant"]: r["element"] for r in vec.dxf_entities(p).collect()}
    assert "20\n100.0000\n" in dxf["arc"] and "50\n310.0000\n51\n350.0000\n" in dxf["arc"] and dxf["line"].startswith("0\nLINE\n8\nHIDDEN\n")
    assert dxf["circle"].startswith("0\nCIRCLE\n8\nVISIBLE\n") and dxf["circle"].count("LINE\n8\nCENTER") == 2 and "10\n77.0000\n20\n100.0000\n11\n123.0000\n" in dxf["circle"]
    svg = {r["variant"]: r["element"] for r in vec.svg_elements(p).collect()}
    assert 'stroke-width="1.00" fill="none" stroke-dasharray="8,4"' in svg["line"] and 'stroke-width="2.00"' in svg["circle"] and svg["arc"].startswith('<path d="M 59.85 501.74 A 10.00 10.00 0 0 1 ')
    assert 'stroke-width="30.00"' in vec.svg_elements(p.withColumn("stroke_width", F.lit(99.0))).first()["element"]


def test_labels_with_crops_and_lone_targets(spark):
    point = "struct<x:double,y:double>"
    rows = [(1, "7", (1.0, 2.0), (3.0, 4.0), [], b"png", [1.0, 2.0, 3.0, 4.0], 100.0), (2, "", None, (3.0, 4.0), [], None, None, 100.0), (3, "", (1.0, 2.0), None, [((0.0, 0.0), None)], None, None, 100.0)]
    a = spark.createDataFrame(rows, f"pos int, label string, at {point}, leader_to {point}, leaders array<struct<p1:{point},p2:{point}>>, crop binary, box array<double>, height double")
    got = {r["pos"]: r["element"] for r in vec.svg_annotations(a).collect()}
    assert list(got) == [1] and got[1].split("\n")[0] == '<line x1="1.00" y1="2.00" x2="3.00" y2="4.00" stroke="black" stroke-width="0.7"/>'
    assert 'href="data:image/png;base64,cG5n" x="1.00" y="2.00" width="3.00" height="4.00"' in got[1] and got[1].endswith(">7</text>")
    assert vec.dxf_annotations(a).count() == 1


def test_batch_gates_failures_and_resume(spark):
    mask = raster.drawn([[(8, 10), (56, 50)]], 64, 64, 3).astype(np.uint8)
    rows = [("EP1", "F1", 64, 64, mask.tobytes()), ("EP1", "F2", 10, 10, b"short"), ("EP1", "F3", None, None, None), ("EP2", "F1", 64, 64, bytes(64 * 64))]
    sketches = spark.createDataFrame(rows, "patent_id string, sketch_id string, height int, width int, mask binary")
    got = {(r["patent_id"], r["sketch_id"]): r for r in batch.run_batch(sketches).collect()}
    assert got["EP1", "F1"]["status"] == "ok" and got["EP1", "F1"]["s3_mean_conf"] > 0.9
    assert got["EP1", "F2"]["status"] == got["EP1", "F3"]["status"] == "stage0" and got["EP1", "F2"]["error"]
    assert got["EP2", "F1"]["status"] == "quality_gate_stage1" and got["EP2", "F1"]["s2_n_edges"] is None
    assert batch.run_batch(sketches, limits=batch.Limits(quality=0)).where("patent_id = 'EP2'").first()["s3_n_primitives"] == 0
    gated = batch.run_batch(sketches, limits=batch.Limits(quality=2.0)).where("status = 'quality_gate_stage1'").count()
    assert gated == 2 and batch.run_batch(sketches, sketches).count() == 0


def test_classifier_on_held_out_strokes(spark):
    rows = learning.stroke_features(synthetic_strokes(spark, 1_500)).withColumn("type", F.col("command.type"))
    model = learning.trained(rows.where(~learning.held_out(F.col("id"))), "type")
    test = learning.predicted(model, rows.where(learning.held_out(F.col("id"))))
    assert test.where("type = guess").count() / test.count() > 0.85


def test_chain_from_a_table(spark):
    table = spark.createDataFrame([(2, "n > 1", "late"), (1, "n > 5", "first")], "place int, condition string, gives string")
    assert [r[0] for r in spark.range(8).selectExpr("cast(id as int) n").select(first_match(steps_of(table))).collect()] == [None, None, "late", "late", "late", "late", "first", "first"]


def test_command_line(spark, tmp_path):
    from vellum.__main__ import main

    page = raster.drawn([[(100, 100), (400, 100), (400, 400), (100, 400), (100, 100)]], 512, 512, 3)
    for x in (440, 452):
        page[200:216, x : x + 8] = True
    (tmp_path / "EP1").mkdir()
    (tmp_path / "EP1" / "EP1_F0001.tif").write_bytes(tiff(page, 4, 1, data=[coded_group_4(page)], dark_zero=False))
    (tmp_path / "EP1" / "EP1_F0002.tif").write_bytes(b"II*\0broken")
    main(["references", "--pages", str(tmp_path / "EP1"), "--out", str(tmp_path / "out")])
    got = {r["path"][-9:]: r for r in spark.read.parquet(str(tmp_path / "out" / "references")).collect()}
    doc = json.loads(got["F0001.tif"]["document"])
    assert doc["schema"] == "stage0_references_v1" and doc["image_size"] == [512, 512] and doc["active_removal"] and doc["n_labels"] == 1 and doc["reference_labels"][0]["bbox"] == [440, 200, 20, 16]
    clean = np.frombuffer(got["F0001.tif"]["gray"], np.uint8).reshape(512, 512)
    assert (clean[200:216, 440:460] == 255).all() and clean[101, 200] == 0 and got["F0002.tif"]["error"]
    main(["filter", "--pages", str(tmp_path / "EP1"), "--out", str(tmp_path / "out"), "--format", "json"])
    pages = {r["path"][-9:]: r for r in spark.read.json(str(tmp_path / "out" / "pages")).collect()}
    assert pages["F0001.tif"]["label"] == "drawing" and pages["F0002.tif"]["reason"] == "load_error"


def test_registered_functions(spark):
    from vellum.functions import registered

    registered.register(spark)
    row = spark.sql("SELECT plain_patent(' ep-1234567 b1') AS p, angle_delta(170, 5) AS a, point_segment(0, 5, 0, 0, 10, 0) AS d, point_segment(3, 4, 0, 0, 0, 0) AS e, fit_confidence(0.5, 1.5) AS c").first()
    assert (row["p"], row["a"], row["d"], row["e"], row["c"]) == ("EP1234567", 15.0, 5.0, 5.0, 0.25)
    points = spark.sql("""SELECT p.* FROM VALUES ('<path d="M 0 0 L 3 4"/>'), (NULL) AS t(svg), LATERAL svg_points(svg) AS p""").collect()
    assert sorted(tuple(p) for p in points) == [(0, 0, 0.0, 0.0), (0, 1, 3.0, 4.0)]
