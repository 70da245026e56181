"""Deeply nested documents to flat, typed tables with parent links.

A bottom-up tree automaton gives every node of a document a state.  Scalars get theirs from their value, arrays from the
states of their elements, and objects from the states of their fields, by the first rule that fits the field they stand in.
So the state of a child record reaches its parent: a chain of well-formed points is a ``polyline``, one without a ``pointless``;
a label whose leaders are recognised is ``leadered``, one without ``leadered_bare``.

The state of a record is its *variant*.  Each variant, also ``other`` for records that fit no rule, has its own table with typed
columns; the keys ``doc, parent_pos, pos`` are common to all (the supertype) and link every row to its parent.
``subtype_tables`` writes them in one pass, a folder per kind of record and variant.

Defined results: a null, empty or unreadable document has no rows; a document may be wrapped in any number of JSON
strings and carry a byte order mark; a null element is no record but keeps its position; a lone object stands for an
array of one; a scalar where an array is due is no record; ``other`` keeps the record as JSON text; NaN and infinite
numbers, written as numbers or as texts, are null in the typed tables; repeated documents give repeated rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import fresh_path

CHUNK = 50_000


@dataclass(frozen=True)
class Rule:
    """``state`` accepts an object whose ``fields`` have one of the given states and whose ``equal`` fields have the given value."""

    state: str
    fields: dict[str, frozenset[str]]
    equal: dict[str, str] = field(default_factory=dict)


NUM, TEXT, PAIR, BOX = frozenset({"num", "numtext"}), frozenset({"text", "numtext"}), frozenset({"pair"}), frozenset({"quad"})
#: Chains of points and sets of leaders as their elements make them; a lone one stands for an array of one.
CHAIN, LEADERS = frozenset({"pairs", "pair"}), frozenset({"leaders", "targeted", "segment", "ray"})

#: Transitions of objects by the field that they stand in, in the order in which they are tried.
RULES: dict[str, list[Rule]] = {
    "primitives": [
        Rule("line", {"p1": PAIR, "p2": PAIR}, {"type": "line"}),
        Rule("arc", {"center": PAIR, "radius": NUM, "start_angle": NUM, "end_angle": NUM}, {"type": "arc"}),
        Rule("circle", {"center": PAIR, "radius": NUM}, {"type": "circle"}),
        Rule("ellipse", {"center": PAIR, "a": NUM, "b": NUM, "angle": NUM}, {"type": "ellipse"}),
        Rule("polygon", {"points": CHAIN}, {"type": "polygon"}),
        Rule("polyline", {"points": CHAIN}, {"type": "polyline"}),
        Rule("pointless", {}, {"type": "polygon"}),
        Rule("pointless", {}, {"type": "polyline"}),
    ],
    "annotations": [
        Rule("leadered", {"bbox": BOX, "leader_lines": LEADERS}, {"removal_mode": "leadered"}),
        Rule("leadered_bare", {"bbox": BOX}, {"removal_mode": "leadered"}),
        Rule("unleadered_lined", {"bbox": BOX, "leader_lines": LEADERS}, {"removal_mode": "unleadered"}),
        Rule("unleadered", {"bbox": BOX}, {"removal_mode": "unleadered"}),
    ],
    "leader_lines": [
        Rule("targeted", {"p1": PAIR, "p2": PAIR, "leader_to": PAIR}),
        Rule("segment", {"p1": PAIR, "p2": PAIR}),
        Rule("ray", {"p1": PAIR}),
    ],
    "hachure": [Rule("group_note", {"pass": TEXT, "length": NUM})],
}
#: Transitions of arrays: the state if all elements that are not null have one of these states.  Numbers alone go by their count.
ARRAYS: list[tuple[str, frozenset[str]]] = [("pairs", PAIR), ("leaders", frozenset({"targeted", "segment", "ray"}))]
COUNTED = {2: "pair", 4: "quad"}
PLAIN = {int, float}
#: Which field of which record nests which kind of child.
NESTED = {"primitives": "points", "annotations": "leader_lines"}
OTHER = "other"

XY = lambda *names: [f"{n}_{i}" for n in names for i in (0, 1)]
NOTE = ["confidence", "edge_id", "hachure.length"]
BOXED = [f"bbox_{i}" for i in range(4)] + XY("position", "leader_to")
#: Numbers of the subtype tables: a field, or a place in an array of numbers.
SUBTYPES: dict[str, dict[str, list[str]]] = {
    "primitives": {
        "line": [*XY("p1", "p2"), *NOTE],
        "arc": [*XY("center"), "radius", "start_angle", "end_angle", *NOTE],
        "circle": [*XY("center"), "radius", *NOTE],
        "ellipse": [*XY("center"), "a", "b", "angle", *NOTE],
        "polygon": NOTE,
        "polyline": NOTE,
        "pointless": NOTE,
        OTHER: NOTE,
    },
    "annotations": {v: BOXED for v in ("leadered", "leadered_bare", "unleadered_lined", "unleadered", OTHER)},
    "leader_lines": {"targeted": XY("p1", "p2", "leader_to"), "segment": XY("p1", "p2"), "ray": XY("p1"), OTHER: []},
    "points": {"pair": ["x", "y"], OTHER: []},
}
#: Texts of the subtype tables.
WORDS = {"primitives": ["type", "style", "source", "hachure.pass"], "annotations": ["id", "text", "kind", "removal_mode", "source"], "leader_lines": [], "points": []}


def column(name: str) -> str:
    return name.replace(".", "_")


NUMBERS = list(dict.fromkeys(column(c) for kinds in SUBTYPES.values() for names in kinds.values() for c in names))
TEXTS = list(dict.fromkeys(column(c) for names in WORDS.values() for c in names)) + ["raw"]


def read_document(payload: object) -> dict | None:
    """The document in a payload, or None if it can't be read to its end or isn't an object."""
    seen = 0
    while isinstance(payload, (str, bytes)):
        if seen > 32:
            return None
        try:
            payload = json.loads(payload.removeprefix("﻿") if isinstance(payload, str) else payload)
        except (ValueError, RecursionError):
            return None
        seen += 1
    return payload if isinstance(payload, dict) else None


def array_state(states: list[str]) -> str:
    """State of an array from those of its elements."""
    if not states:
        return "empty"
    present = set(states)
    if present == {"num"}:
        return COUNTED.get(len(states), "list")
    known = present - {"null"}
    for state, members in ARRAYS:
        if known and known <= members:
            return state
    return "list"


def state_of(value: object, symbol: str = "") -> str:
    """State of a node that stands in the field ``symbol``, from the leaves up."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "num"
    if isinstance(value, str):
        try:
            return "numtext" if math.isfinite(float(value)) else "text"
        except ValueError:
            return "text"
    if isinstance(value, list):
        return array_state([state_of(x, symbol) for x in value])
    rules = RULES.get(symbol)
    return object_state(symbol, value, {k: state_of(v, k) for k, v in value.items()}) if rules else "object"


def object_state(symbol: str, record: dict, states: dict[str, str]) -> str:
    """State of an object from those of its fields."""
    for rule in RULES[symbol]:
        if all(record.get(k) == v for k, v in rule.equal.items()) and all(states.get(k, "null") in s for k, s in rule.fields.items()):
            return rule.state
    return OTHER


def elements(kind: str, value: object) -> list:
    """The array that a field stands for; a lone object or a lone point is an array of one."""
    if isinstance(value, list):
        return [value] if kind == "points" and state_of(value) == "pair" else value
    return [value] if isinstance(value, dict) else []


def variant_of(kind: str, record: object) -> str:
    """The variant of a record of this kind: its state, if its kind has a table for it."""
    state = state_of(record, kind)
    return state if state in SUBTYPES[kind] else OTHER


Record = tuple[str, int, int, str, object]


def classified(kind: str, record: object, pos: int, out: list[Record]) -> str:
    """State of a first-level record; its child records, classified before it, go to ``out`` with their states."""
    if not isinstance(record, dict):
        return OTHER
    below, states = NESTED[kind], {}
    for k, v in record.items():
        if k != below:
            states[k] = state_of(v, k)
            continue
        own = elements(below, v)
        found = ["pair" if is_numbers(x, 2) else state_of(x, below) for x in own]
        states[k] = array_state(found) if own or isinstance(v, list) else state_of(v, k)
        tables = SUBTYPES[below]
        out.extend((below, pos, i, s if s in tables else OTHER, x) for i, (s, x) in enumerate(zip(found, own)) if x is not None)
    return object_state(kind, record, states)


def records(document: dict) -> Iterator[Record]:
    """All child records as ``(child, parent_pos, pos, variant, value)``, children before their parents."""
    for kind in NESTED:
        for pos, record in enumerate(elements(kind, document.get(kind))):
            if record is None:
                continue
            out: list[Record] = []
            variant = classified(kind, record, pos, out)
            yield from out
            yield kind, -1, pos, variant, record


def finite(value: object) -> float | None:
    """A finite number, or a text of one; None for anything else."""
    if value is None or isinstance(value, (bool, list, dict)):
        return None
    try:
        x = float(value)
    except (ValueError, OverflowError):
        return None  # a text that is no number, or an integer beyond a double
    return x if math.isfinite(x) else None


def is_numbers(value: object, n: int) -> bool:
    """Whether a value is an array of so many numbers."""
    return type(value) is list and len(value) == n and all(type(x) in PLAIN for x in value)


def number_at(record: dict, path: str) -> float | None:
    """A finite number of a record: a field, a field of a nested object (``a.b``), or a place in an array of numbers (``a_0``)."""
    if path in record:
        return finite(record[path])
    if "." in path:
        a, b = path.split(".")
        return finite(record[a].get(b)) if isinstance(record.get(a), dict) else None
    array = record.get(path[:-2]) if path[-2:-1] == "_" else None
    good = type(array) is list and len(array) in COUNTED and is_numbers(array, len(array)) and int(path[-1]) < len(array)
    return finite(array[int(path[-1])]) if good else None


def typed_columns(values: list, paths: list[str]) -> dict[str, pa.Array]:
    """Columns of numbers out of records of one variant; the places of an array are taken together."""
    if paths == ["x", "y"]:
        return {c: pa.array([finite(v[i]) for v in values], pa.float64()) for i, c in enumerate(paths)}
    out = {}
    for path in paths:
        if path[-2:] == "_0":
            base = path[:-2]
            n = sum(p[:-2] == base and p[-2] == "_" for p in paths)
            arrays = [a if isinstance(v, dict) and is_numbers(a := v.get(base), n) else None for v in values]
            out |= {f"{base}_{i}": pa.array([finite(a[i]) if a else None for a in arrays], pa.float64()) for i in range(n)}
        elif path not in out:
            out[column(path)] = pa.array([number_at(v, path) if isinstance(v, dict) else None for v in values], pa.float64())
    return out


def text_at(record: object, path: str) -> str | None:
    a, _, b = path.partition(".")
    value = record.get(a) if isinstance(record, dict) else None
    value = value.get(b) if b and isinstance(value, dict) else None if b else value
    return value if isinstance(value, str) else None


KEYS = ["child", "variant", "parent_pos", "pos"]
KEY_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32()]
KEY_DDL = "doc bigint, child string, variant string, parent_pos int, pos int"


def documents_of(docs: DataFrame, doc_key: str, payload: str) -> DataFrame:
    return docs.select(F.col(doc_key).cast("bigint").alias("doc"), F.col(payload).alias("payload")).where("payload is not null")


def shred(docs: DataFrame, doc_key: str = "doc_no", payload: str = "payload", kinds: Iterable[str] = ("primitives", "annotations", "points", "leader_lines"), fields: bool = True) -> DataFrame:
    """One row per child record of the wanted kinds: keys, variant and (if asked) the typed columns of all subtypes.

    One narrow pass without a shuffle; rows leave in chunks, so a document with millions of points needs little memory.
    Columns that a variant lacks are null blocks and cost next to nothing.
    """
    kinds = frozenset(kinds)
    typed = [(c, pa.float64()) for c in NUMBERS] + [(c, pa.string()) for c in TEXTS] if fields else []
    schema = pa.schema([("doc", pa.int64()), *zip(KEYS, KEY_TYPES), *typed])

    def batch_of(child: str, variant: str, rows: list[tuple]) -> pa.RecordBatch:
        docs, parents, places, values = zip(*rows)
        n = len(rows)
        columns = {"doc": pa.array(docs, pa.int64()), "child": pa.repeat(child, n), "variant": pa.repeat(variant, n), "parent_pos": pa.array(parents, pa.int32()), "pos": pa.array(places, pa.int32())}
        if fields:
            columns |= typed_columns(values, SUBTYPES[child][variant])
            columns |= {column(c): pa.array([text_at(v, c) for v in values], pa.string()) for c in WORDS[child]}
            if variant == OTHER:
                columns["raw"] = pa.array([json.dumps(v, ensure_ascii=False) for v in values], pa.string())
        return pa.RecordBatch.from_arrays([columns[c.name] if c.name in columns else pa.nulls(n, c.type) for c in schema], schema=schema)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[tuple]] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                document = read_document(text)
                for child, parent, pos, variant, record in records(document) if document else ():
                    if child in kinds:
                        rows = held.setdefault((child, variant), [])
                        rows.append((doc, parent, pos, record if fields else None))
                        if len(rows) >= CHUNK:
                            yield batch_of(child, variant, held.pop((child, variant)))
            for key in list(held):
                yield batch_of(*key, held.pop(key))

    ddl = KEY_DDL + "".join(f", `{c}` double" for c in NUMBERS) + "".join(f", `{c}` string" for c in TEXTS) if fields else KEY_DDL
    return documents_of(docs, doc_key, payload).mapInArrow(shape, ddl).withColumnRenamed("doc", doc_key)


def typed_table(shredded: DataFrame, child: str, variant: str, doc_key: str = "doc_no") -> DataFrame:
    """Typed table of one variant, with the common keys first."""
    numbers = [F.col(column(c)).try_cast("int").alias(c) if c == "edge_id" else F.col(column(c)) for c in SUBTYPES[child][variant]]
    raw = ["raw"] if variant == OTHER else []
    return shredded.where((F.col("child") == child) & (F.col("variant") == variant)).select(doc_key, "parent_pos", "pos", *numbers, *map(column, WORDS[child]), *raw)


class SubtypeTables:
    """The typed tables of documents, written in one pass: a folder per kind of record and variant in the shared folder."""

    def __init__(self, docs: DataFrame, doc_key: str = "doc_no", payload: str = "payload"):
        rows = shred(docs, doc_key, payload)
        self.doc_key, self.path = doc_key, fresh_path(docs.sparkSession, "subtypes")
        rows.write.partitionBy("child", "variant").parquet(self.path)
        self.all = docs.sparkSession.read.schema(rows.schema).parquet(self.path)

    def table(self, child: str, variant: str) -> DataFrame:
        """One typed table; only its folder is read."""
        return typed_table(self.all, child, variant, self.doc_key)

    def supertype(self) -> DataFrame:
        """Common keys of the union of all typed tables."""
        return self.all.select(self.doc_key, *KEYS)


def chains(docs: DataFrame, doc_key: str = "doc_no", payload: str = "payload") -> DataFrame:
    """``(doc, prim, closed, pts)``: one row per primitive with its well-formed points ``(k, x, y)`` in order; one narrow pass.

    Primitives without such points have no row; ``k`` is a point's position in the document's array; polygons are closed.
    """
    point = pa.struct([("k", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])
    schema = pa.schema([("doc", pa.int64()), ("prim", pa.int32()), ("closed", pa.bool_()), ("pts", pa.list_(point))])

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prims, closed, ends, k, x, y = [], [], [], [0], [], [], []

            def flush() -> pa.RecordBatch:
                values = pa.StructArray.from_arrays([pa.array(k, pa.int32()), pa.array(x, pa.float64()), pa.array(y, pa.float64())], fields=list(point))
                pts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(prims, pa.int32()), pa.array(closed, pa.bool_()), pts.cast(schema.field("pts").type)], schema=schema)

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                document = read_document(text)
                for pos, record in enumerate(elements("primitives", document.get("primitives")) if document else ()):
                    own = [(i, finite(p[0]), finite(p[1])) for i, p in enumerate(elements("points", record.get("points"))) if is_numbers(p, 2)] if isinstance(record, dict) else []
                    own = [p for p in own if p[1] is not None and p[2] is not None]
                    if not own:
                        continue
                    for column_, values in zip((k, x, y), zip(*own)):
                        column_.extend(values)
                    keys.append(doc)
                    prims.append(pos)
                    closed.append(record.get("type") == "polygon")
                    ends.append(len(k))
                    if len(k) >= CHUNK:
                        yield flush()
                        keys, prims, closed, ends, k, x, y = [], [], [], [0], [], [], []
            if keys:
                yield flush()

    return documents_of(docs, doc_key, payload).mapInArrow(shape, "doc bigint, prim int, closed boolean, pts array<struct<k:int,x:double,y:double>>").withColumnRenamed("doc", doc_key)


def headers(docs: DataFrame, doc_key: str = "doc_no", payload: str = "payload") -> DataFrame:
    """``(doc, width, height, stroke_width, stage2_scale)`` of every document that can be read; what is missing or mistyped is null."""
    names = ["image_size_0", "image_size_1", "stroke_width", "stage2_scale"]
    schema = pa.schema([("doc", pa.int64()), ("width", pa.float64()), ("height", pa.float64()), ("stroke_width", pa.float64()), ("stage2_scale", pa.float64())])

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [(doc, read_document(text)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            read = [(doc, d) for doc, d in read if d]
            yield pa.RecordBatch.from_arrays([pa.array([doc for doc, _ in read], pa.int64()), *[pa.array([number_at(d, c) for _, d in read], pa.float64()) for c in names]], schema=schema)

    return documents_of(docs, doc_key, payload).mapInArrow(shape, "doc bigint, width double, height double, stroke_width double, stage2_scale double").withColumnRenamed("doc", doc_key)


def label_counts(docs: DataFrame, doc_key: str = "doc_no", payload: str = "payload") -> DataFrame:
    """``(doc, n_annotations, n_leaders)`` of every readable document; leaders that are marked as not removed don't count."""
    schema = pa.schema([("doc", pa.int64()), ("n_annotations", pa.int64()), ("n_leaders", pa.int64())])

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                document = read_document(text)
                if document:
                    own = [(c, r) for c, _, _, _, r in records(document) if c in ("annotations", "leader_lines")]
                    kept = sum(c == "leader_lines" and not (isinstance(r, dict) and r.get("removed") is False) for c, r in own)
                    rows.append((doc, sum(c == "annotations" for c, _ in own), kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=schema)

    return documents_of(docs, doc_key, payload).mapInArrow(shape, "doc bigint, n_annotations bigint, n_leaders bigint").withColumnRenamed("doc", doc_key)
