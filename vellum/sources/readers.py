"""Sources: folder walks, rasters, manifests, documents, split files and SVG geometry, all with declared schemas."""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.keys import last_part
from vellum.operators import raster
from vellum.sources.tiff import decoded_tiff


def corpus_walk(spark: SparkSession, root: str, pattern: str = "*.{tif,tiff,TIF,TIFF}") -> DataFrame:
    """``(patent_id, sketch_id, letter_code, path, n_bytes)`` of a two-level folder; contents are pruned, nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("n_bytes"))
    name, patent = last_part(F.col("path")), F.element_at(F.split("path", "/"), -2)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    sketch = F.when(F.startswith(stem, F.concat(patent, F.lit("_"))), F.substr(stem, F.length(patent) + 2)).otherwise(stem)
    return files.select(patent.alias("patent_id"), sketch.alias("sketch_id"), F.upper(F.regexp_extract(name, r"(?i)_([A-Z])\d+\.[^.]*$", 1)).alias("letter_code"), "path", "n_bytes")


def decoded(data: bytes) -> np.ndarray | None:
    """Grey image of a TIFF file, a binary PGM or an 8-bit PNG without interlacing; None for anything else or broken data."""
    try:
        if data[:4] in (b"II*\0", b"MM\0*"):
            return decoded_tiff(data)
        if data[:2] == b"P5":
            head = re.match(rb"P5(?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+(\d+)\s", data)
            w, h = int(head[1]), int(head[2])
            return np.frombuffer(data, np.uint8, w * h, head.end()).reshape(h, w)
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, packed, shape = 8, b"", None
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
                channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
                if depth != 8 or interlace or channels is None:
                    return None
                shape = h, w, channels
            elif kind == b"IDAT":
                packed += body
            at += size + 12
        h, w, c = shape
        rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, w * c + 1)
        out = np.zeros((h, w * c), np.uint8)
        above = np.zeros(w * c, int)
        for y, row in enumerate(rows):
            line, now = row[1:].astype(int), np.zeros(w * c, int)
            if row[0] in (0, 2):
                now = (line + (above if row[0] == 2 else 0)) & 255
            else:
                for x in range(w * c):
                    left, up, corner = now[x - c] if x >= c else 0, above[x], above[x - c] if x >= c else 0
                    if row[0] == 1:
                        guess = left
                    elif row[0] == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                    now[x] = (line[x] + guess) & 255
            out[y], above = now, now
        image = out.reshape(h, w, c)
        return image[..., 0] if c < 3 else np.round(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    except (TypeError, ValueError, struct.error, zlib.error):
        return None


def rasters(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, height, width, gray)`` of image files; files that can't be decoded have nulls, empty files have no row."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = [decoded(bytes(x)) for x in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "height": [i.shape[0] if i is not None else None for i in images], "width": [i.shape[1] if i is not None else None for i in images], "gray": [i.tobytes() if i is not None else None for i in images]}).astype({"height": "Int32", "width": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInPandas(read, "path string, height int, width int, gray binary")


def page_rows(spark: SparkSession, root: str, pattern: str = "*.{tif,TIF,tiff,TIFF}", longest: int = raster.PAGE) -> DataFrame:
    """``(path, label, features)`` of page images: brought to ``longest`` pixels, cut at half brightness and measured; what can't be read has the label ``error``."""
    names = list(raster.page_features(np.zeros((1, 1), bool)))
    whole = ("n_cc", "long_lines", "skel_n_cc")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                gray = decoded(bytes(content))
                rows.append({"path": path, "label": "error" if gray is None else None} | (raster.page_features(raster.resized(gray, longest) < 128) if gray is not None else {}))
            yield pd.DataFrame(rows, columns=["path", "label", *names]).astype({c: "Int32" if c in whole else "float64" for c in names})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInPandas(measure, "path string, label string, " + ", ".join(f"{c} {'int' if c in whole else 'double'}" for c in names))


def numbered_images(spark: SparkSession, root: str) -> DataFrame:
    """``(number, path, height, width, gray)`` of the PNG files whose name is a number, in the order of it."""
    stem = F.regexp_extract(last_part(F.col("path")), r"^(\d+)\.[^.]*$", 1)
    return rasters(spark, root, "*.png").withColumn("number", F.when(stem != "", stem.try_cast("bigint"))).where("number is not null").select("number", "path", "height", "width", "gray").orderBy("number")


def label_packs(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Key point labels of one split: ``(path, x, y, kind)`` with one row per point, out of packs of a skeleton, ``n x 3`` whole numbers and a note."""
    import io

    kinds = ("endpoint", "junction", "corner")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as pack:
                        points = np.asarray(pack["kps"]).reshape(-1, 3).astype(int)
                except (ValueError, KeyError, OSError, zipfile.BadZipFile):
                    continue
                rows += [(path, x, y, kinds[k]) for x, y, k in points.tolist() if 0 <= k < len(kinds)]
            yield pd.DataFrame(rows, columns=["path", "x", "y", "kind"]).astype({"x": "int32", "y": "int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(f"{root.rstrip('/')}/{split}")
    return files.select("path", "content").mapInPandas(read, "path string, x int, y int, kind string")


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(sketch_id, labeled_classes, x, y, type)`` of the gold documents that a person has reviewed; the others are drafts."""
    schema = "sketch_id string, shape array<int>, labeled_classes array<string>, reviewed boolean, keypoints array<struct<x:int,y:int,type:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).where(F.coalesce("reviewed", F.lit(False)))
    return rows.select("sketch_id", "labeled_classes", F.inline_outer("keypoints"))


def text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column a string; numbers are made with ``number`` and ``whole``."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, multiLine=True, escape='"')


def number(c: Column | str, default: float = 0.0) -> Column:
    """A double of a text; null, blank, NaN and other texts give the default."""
    x = F.trim(F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(F.lit(default))


def whole(c: Column | str, default: int = 0) -> Column:
    """A whole number of a text, cut towards zero; infinite and too large numbers give the default."""
    x = number(c, float(default))
    return F.when(F.abs(x) < 2147483647.0, x.cast("int")).otherwise(F.lit(default))


def documents(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON documents that have all required fields, and the others with the names of what they lack."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    lack = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    checked = rows.withColumn("lacking", lack)
    return checked.where(F.size("lacking") == 0).drop("lacking"), checked.where(F.size("lacking") > 0)


def split_file(spark: SparkSession, path: str, names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """``(split, group_id, item)`` of a JSON object of lists of ``group/item``."""
    rows = spark.read.schema(", ".join(f"`{n}` array<string>" for n in names)).json(path, multiLine=True)
    each = rows.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.col(n), F.array().cast("array<string>")))])).alias("split", "ids"))
    return each.select("split", F.explode("ids").alias("id")).select("split", F.substring_index("id", "/", 1).alias("group_id"), F.substring_index("id", "/", -1).alias("item"))


TOKEN = re.compile(r"[MLCZ]|-?\d+(?:\.\d+)?(?:[eE]-?\d+)?")


def flattened(d: str, samples: int = 16) -> list[list[tuple[float, float]]]:
    """Chains of a path with absolute M, L, C and Z; pairs after M are lines, cubics become ``samples`` points."""
    out: list[list[tuple[float, float]]] = []
    tokens, command, at = TOKEN.findall(d), "", 0
    while at < len(tokens):
        if tokens[at] in "MLCZ":
            command = tokens[at]
            at += 1
            if command == "Z" and out and out[-1]:
                out[-1].append(out[-1][0])
            continue
        need = 6 if command == "C" else 2
        try:
            v = [float(x) for x in tokens[at : at + need]]
        except ValueError:
            break
        if len(v) < need or command in ("", "Z") or (command == "C" and not out):
            break
        at += need
        if command == "M":
            out.append([(v[0], v[1])])
            command = "L"
        elif command == "L":
            out[-1].append((v[0], v[1]))
        else:
            (x0, y0), t = out[-1][-1], np.linspace(0, 1, samples + 1)[1:]
            w = (1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3
            out[-1].extend(zip((w[0] * x0 + w[1] * v[0] + w[2] * v[2] + w[3] * v[4]).tolist(), (w[0] * y0 + w[1] * v[1] + w[2] * v[3] + w[3] * v[5]).tolist()))
    return out


def svg_chains(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, path, step, x, y)`` of all paths of SVG texts, cubics flattened."""
    paths = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r'<path[^>]*? d="([^"]*)"'), F.lit(1))).alias("path", "d"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(n, p, k, x, y) for n, p, d in zip(frame[key], frame["path"], frame["d"]) for k, (x, y) in enumerate(xy for chain in flattened(d) for xy in chain)]
            yield pd.DataFrame(rows, columns=[key, "path", "step", "x", "y"])

    return paths.mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, path int, step int, x double, y double")


def path_count(text: Column) -> Column:
    """How many paths an SVG text holds; -1 for a text that could not be read."""
    return F.coalesce(F.regexp_count(text, F.lit("<path")), F.lit(-1))


def svg_points(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, shape, k, x, y)`` of the polylines and polygons of SVG texts, by expressions alone; curves are left to ``svg_chains``."""
    shapes = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r'<poly(?:line|gon) points="([^"]*)"'), F.lit(1))).alias("shape", "points"))
    points = shapes.select(key, "shape", F.posexplode(F.split("points", " +")).alias("k", "p"))
    xy = F.split("p", ",")
    return points.select(key, "shape", "k", xy[0].try_cast("double").alias("x"), xy[1].try_cast("double").alias("y"))


SHAPE = re.compile(r"<(line|circle|ellipse|polyline|polygon|path)\b([^>]*)>")
ATTRIBUTE = re.compile(r'([\w-]+)="([^"]*)"')
VIEW = re.compile(r'viewBox="\s*(-?[\d.]+)[ ,]+(-?[\d.]+)[ ,]+([\d.]+)[ ,]+([\d.]+)')


def svg_shapes(text: str) -> list[list[tuple[float, float]]]:
    """Chains of points of an SVG text's lines, circles, ellipses, polylines, polygons, and paths with absolute M, L, C, Z."""
    out = []
    for kind, rest in SHAPE.findall(text):
        a = dict(ATTRIBUTE.findall(rest))
        try:
            n = lambda k: float(a.get(k, 0))  # noqa: B023, E731
            if kind == "line":
                out.append([(n("x1"), n("y1")), (n("x2"), n("y2"))])
            elif kind in ("circle", "ellipse"):
                rx, ry = (n("r"), n("r")) if kind == "circle" else (n("rx"), n("ry"))
                t = np.linspace(0, 2 * np.pi, 97)
                out.append(list(zip((n("cx") + rx * np.cos(t)).tolist(), (n("cy") + ry * np.sin(t)).tolist())))
            elif kind == "path":
                out += flattened(a.get("d", ""))
            else:
                v = [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?(?:[eE]-?\d+)?", a.get("points", ""))]
                chain = list(zip(v[::2], v[1::2]))
                out.append(chain + chain[:1] * (kind == "polygon"))
        except ValueError:
            continue
    return [c for c in out if len(c) > 1]


def svg_mask(text: str, size: int = 1_024, width: int = 3) -> np.ndarray:
    """Ink of an SVG text drawn on a square of ``size`` pixels; without a view box it is 200 by 200."""
    view = VIEW.search(text)
    x0, y0, w, h = map(float, view.groups()) if view else (0.0, 0.0, 200.0, 200.0)
    k = size / max(w, h, 1e-9)
    return raster.drawn([[((x - x0) * k, (y - y0) * k) for x, y in c] for c in svg_shapes(text)], size, size, width)
