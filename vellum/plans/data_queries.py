"""Queries of the general training-data operators (problems 1, 3 and 4) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import compaction, nested, orphans
from vellum.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all child records: the union of the typed tables that the automaton routes them to."""
    return nested.SubtypeTables(table(spark, sf_dir, "primitive_docs")).supertype().select("doc_no", "child", "parent_pos", "pos")


def p1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each subtype table gets."""
    return nested.shred(table(spark, sf_dir, "primitive_docs"), fields=False).groupBy("child", "variant").agg(F.count("*").alias("n_records"), F.countDistinct("doc_no").alias("n_docs"))


def typed(spark: SparkSession, sf_dir: str, child: str, variant: str, *columns: str) -> DataFrame:
    rows = nested.typed_table(nested.shred(table(spark, sf_dir, "primitive_docs"), kinds=(child,)), child, variant)
    return rows.select("doc_no", "pos", *columns)


def p1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of lines."""
    return typed(spark, sf_dir, "primitives", "line", "edge_id", "p1_0", "p1_1", "p2_0", "p2_1", "confidence", "style", "hachure_pass", "hachure_length")


def p1_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of arcs."""
    return typed(spark, sf_dir, "primitives", "arc", "edge_id", "center_0", "center_1", "radius", "start_angle", "end_angle", "confidence", "style")


def p1_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of circles."""
    return typed(spark, sf_dir, "primitives", "circle", "edge_id", "center_0", "center_1", "radius", "confidence", "style")


def p1_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of ellipses."""
    return typed(spark, sf_dir, "primitives", "ellipse", "edge_id", "center_0", "center_1", "a", "b", "angle", "confidence", "style")


def p1_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines, polygons and those without a point, with the number of points that link to each."""
    rows = nested.shred(table(spark, sf_dir, "primitive_docs"), kinds=("primitives", "points"))
    n = F.count_if(F.col("child") == "points")
    place = F.when(F.col("child") == "points", F.col("parent_pos")).otherwise(F.col("pos"))
    own = rows.groupBy("doc_no", place.alias("pos")).agg(F.max(F.when(F.col("child") == "primitives", F.col("variant"))).alias("variant"), n.alias("n_points"))
    return own.where("variant in ('polyline', 'polygon', 'pointless')")


def p1_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of points."""
    return typed(spark, sf_dir, "points", "pair", "parent_pos", "x", "y")


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed tables of the four kinds of labels in one."""
    rows = nested.shred(table(spark, sf_dir, "primitive_docs"), kinds=("annotations",))
    return rows.where("variant <> 'other'").select("doc_no", "pos", "variant", *[f"bbox_{i}" for i in range(4)], "position_0", "position_1", "id", "text", "kind", "removal_mode")


def p1_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed tables of leaders in one: with a target, as a segment, as a ray."""
    rows = nested.shred(table(spark, sf_dir, "primitive_docs"), kinds=("leader_lines",))
    return rows.where("variant <> 'other'").select("doc_no", "parent_pos", "pos", "variant", "p1_0", "p1_1", "p2_0", "p2_1", "leader_to_0", "leader_to_1")


def p3_state(spark: SparkSession, sf_dir: str) -> list[tuple[str, orphans.OrphanState]]:
    return orphans.replay(*orphans.corpus_references(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_state(spark, sf_dir)[-1][1].orphans()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field, month and state after all events."""
    return p3_state(spark, sf_dir)[-1][1].snapshot()


def p3_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts as they stood at the end of every half-year."""
    return orphans.snapshots(p3_state(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compact_documents(table(spark, sf_dir, "artifact_files"))[0].select("file_no")


def p4_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of text per kind in the compacted output."""
    docs, _ = compaction.compact_documents(table(spark, sf_dir, "artifact_files"))
    return docs.groupBy("kind").agg(F.count("*").alias("n_docs"), F.sum(F.length("body")).alias("n_chars"))


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files written: how many small files, blocks and rows each took in, and its size."""
    return compaction.compact_documents(table(spark, sf_dir, "artifact_files"))[1].select("n_files", "n_blocks", "n_rows", "n_bytes")


QUERIES = {f.__name__: f for f in (p1_found, p1_variants, p1_lines, p1_arcs, p1_circles, p1_ellipses, p1_chains, p1_points, p1_labels, p1_leaders, p3_found, p3_report, p3_snapshots, p4_found, p4_layout, p4_files)}

P1_RECORDS = """
docs AS (SELECT doc_no, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END END AS body FROM primitive_docs),
good AS (SELECT doc_no, body::JSON AS body FROM docs WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
top AS (SELECT doc_no, child, CASE json_type(v) WHEN 'ARRAY' THEN v::JSON[] WHEN 'OBJECT' THEN [v] ELSE [] END AS items
        FROM (SELECT doc_no, 'primitives' AS child, body->'primitives' AS v FROM good UNION ALL SELECT doc_no, 'annotations', body->'annotations' FROM good)),
upper_rows AS (SELECT doc_no, child, i - 1 AS pos, items[i] AS item FROM top, unnest(range(1, len(items) + 1)) AS u(i)),
first_level AS (SELECT * FROM upper_rows WHERE json_type(item) <> 'NULL'),
deep AS (SELECT doc_no, CASE child WHEN 'primitives' THEN 'points' ELSE 'leader_lines' END AS child, pos AS parent_pos,
         CASE child WHEN 'primitives' THEN item->'points' ELSE item->'leader_lines' END AS v FROM first_level),
deep_items AS (SELECT doc_no, child, parent_pos, CASE json_type(v) WHEN 'ARRAY' THEN v::JSON[] WHEN 'OBJECT' THEN [v] ELSE [] END AS items FROM deep),
deep_rows AS (SELECT doc_no, child, parent_pos, i - 1 AS pos, items[i] AS item FROM deep_items, unnest(range(1, len(items) + 1)) AS u(i)),
records AS (SELECT doc_no, child, -1 AS parent_pos, pos, item FROM first_level UNION ALL SELECT doc_no, child, parent_pos, pos, item FROM deep_rows WHERE json_type(item) <> 'NULL')
"""
SQL_PATENT = "left(upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')), 9)"
#: The paths of the test tables: slashes either way, single dots, doubled slashes and 'x/../' as the only parents.
SQL_PATH = r"""regexp_extract(regexp_replace(regexp_replace(regexp_replace(trim(replace({0}, '\', '/')), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '(?:^|.*/)runs/corpus_gated/(.*)$', 1)"""
P3_ORPHANS = f"""
refs AS (
  SELECT 'training_manifest' AS ref_table, 'graph_path' AS ref_field, load_no, loaded_at, {SQL_PATH.format("graph_path")} AS k FROM training_manifest WHERE trim(graph_path) <> ''
  UNION ALL SELECT 'training_manifest', 'svg_path', load_no, loaded_at, {SQL_PATH.format("svg_path")} FROM training_manifest WHERE trim(svg_path) <> ''
  UNION ALL SELECT 'results', 'filename', load_no, loaded_at, {SQL_PATENT.format("patent_id")} || '|' || regexp_extract(trim(input_path), '([^/\\\\]*)$', 1) FROM results),
parents AS (
  SELECT {SQL_PATH.format("path")} AS k, created_at AS since, deleted_at AS until FROM artifact_files
  UNION ALL SELECT {SQL_PATENT.format("patent")} || '|' || filename, loaded_at, removed_at FROM filter_manifest),
keyed AS (SELECT k, min(since) FILTER (WHERE until IS NULL) AS first_live FROM parents GROUP BY k),
orphans AS (
  SELECT ref_table, ref_field, load_no, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS ref_month,
         CASE WHEN keyed.k IS NULL THEN 'missing' WHEN first_live IS NULL THEN 'deleted' WHEN first_live > loaded_at THEN 'late' END AS ref_state
  FROM refs LEFT JOIN keyed ON refs.k = keyed.k)
"""
P4_DOCS = """
live AS (SELECT file_no, kind, patent_id, created_at, body, json_extract_string(body, '$.sketch_id') AS sketch_id FROM artifact_files
         WHERE kind IN ('graph', 'primitives') AND deleted_at IS NULL AND json_valid(body) AND json_type(body) = 'OBJECT'),
kept AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY kind, patent_id, sketch_id ORDER BY created_at DESC, file_no DESC) = 1)
"""
SQL_VARIANT = """CASE child WHEN 'primitives' THEN CASE WHEN item->>'type' IN ('line', 'arc', 'circle', 'ellipse') THEN item->>'type'
    WHEN json_type(item->'points') = 'ARRAY' AND len(list_filter((item->'points')::JSON[], lambda x: json_type(x) <> 'NULL')) > 0 THEN item->>'type' ELSE 'pointless' END
  WHEN 'annotations' THEN CASE WHEN json_type(item->'leader_lines') = 'OBJECT' OR (json_type(item->'leader_lines') = 'ARRAY' AND len(list_filter((item->'leader_lines')::JSON[], lambda x: json_type(x) <> 'NULL')) > 0)
    THEN CASE item->>'removal_mode' WHEN 'leadered' THEN 'leadered' ELSE 'unleadered_lined' END ELSE CASE item->>'removal_mode' WHEN 'leadered' THEN 'leadered_bare' ELSE 'unleadered' END END
  WHEN 'points' THEN CASE WHEN json_array_length(item) = 2 THEN 'pair' ELSE 'other' END
  ELSE CASE WHEN json_type(item->'p2') = 'ARRAY' AND json_type(item->'leader_to') = 'ARRAY' THEN 'targeted' WHEN json_type(item->'p2') = 'ARRAY' THEN 'segment' ELSE 'ray' END END"""


def sql_typed(kind: str, pairs: list[str], numbers: list[str], more: str = "") -> str:
    """SQL of the typed table of one kind of primitive."""
    columns = [f"(item->>'$.{p}[{i}]')::DOUBLE AS {p}_{i}" for p in pairs for i in (0, 1)] + [f"(item->>'{c}')::DOUBLE AS {c}" for c in numbers]
    sure = "CASE WHEN isfinite(TRY_CAST(item->>'confidence' AS DOUBLE)) THEN TRY_CAST(item->>'confidence' AS DOUBLE) END AS confidence"
    return f"WITH {P1_RECORDS} SELECT doc_no, pos::INT AS pos, (item->>'edge_id')::INT AS edge_id, {', '.join(columns)}, {sure}, item->>'style' AS style{more} FROM records WHERE child = 'primitives' AND item->>'type' = '{kind}'"


ORACLES = {
    "p1_found": f"WITH {P1_RECORDS} SELECT doc_no, child, parent_pos::INT AS parent_pos, pos::INT AS pos FROM records",
    "p1_variants": f"""WITH {P1_RECORDS}, v AS (SELECT doc_no, child, {SQL_VARIANT} AS variant FROM records)
        SELECT child, variant, count(*) AS n_records, count(DISTINCT doc_no) AS n_docs FROM v GROUP BY ALL""",
    "p1_lines": sql_typed("line", ["p1", "p2"], [], ", item->'hachure'->>'pass' AS hachure_pass, (item->'hachure'->>'length')::DOUBLE AS hachure_length"),
    "p1_arcs": sql_typed("arc", ["center"], ["radius", "start_angle", "end_angle"]),
    "p1_circles": sql_typed("circle", ["center"], ["radius"]),
    "p1_ellipses": sql_typed("ellipse", ["center"], ["a", "b", "angle"]),
    "p1_chains": f"""WITH {P1_RECORDS}, n AS (SELECT doc_no, parent_pos AS pos, count(*) AS n FROM records WHERE child = 'points' GROUP BY ALL)
        SELECT r.doc_no, r.pos::INT AS pos, CASE WHEN n.n > 0 THEN item->>'type' ELSE 'pointless' END AS variant, coalesce(n.n, 0) AS n_points FROM (SELECT * FROM records WHERE child = 'primitives' AND item->>'type' IN ('polyline', 'polygon')) r LEFT JOIN n USING (doc_no, pos)""",
    "p1_points": f"WITH {P1_RECORDS} SELECT doc_no, parent_pos::INT AS parent_pos, pos::INT AS pos, (item->>0)::DOUBLE AS x, (item->>1)::DOUBLE AS y FROM records WHERE child = 'points'",
    "p1_labels": f"""WITH {P1_RECORDS} SELECT doc_no, pos::INT AS pos, {SQL_VARIANT} AS variant, {", ".join(f"(item->>'$.bbox[{i}]')::DOUBLE AS bbox_{i}" for i in range(4))}, (item->>'$.position[0]')::DOUBLE AS position_0, (item->>'$.position[1]')::DOUBLE AS position_1,
        {", ".join(f"CASE WHEN json_type(item->'{c}') = 'VARCHAR' THEN item->>'{c}' END AS {c}" for c in ("id", "text", "kind", "removal_mode"))} FROM records WHERE child = 'annotations'""",
    "p1_leaders": f"""WITH {P1_RECORDS} SELECT doc_no, parent_pos::INT AS parent_pos, pos::INT AS pos, {SQL_VARIANT} AS variant, {", ".join(f"(item->>'$.{c}[{i}]')::DOUBLE AS {c}_{i}" for c in ("p1", "p2", "leader_to") for i in (0, 1))} FROM records WHERE child = 'leader_lines'""",
    "p3_found": f"WITH {P3_ORPHANS} SELECT * FROM orphans WHERE ref_state IS NOT NULL",
    "p3_report": f"WITH {P3_ORPHANS} SELECT ref_table, ref_field, ref_month, ref_state, count(*) AS n_refs FROM orphans WHERE ref_state IS NOT NULL GROUP BY ALL",
    "p3_snapshots": f"""WITH {P3_ORPHANS.replace("keyed AS (", "all_keyed AS (").replace("orphans AS (", "all_orphans AS (").replace("keyed.", "all_keyed.").replace("JOIN keyed", "JOIN all_keyed")},
        rp AS (SELECT *, floor((year(loaded_at) * 12 + month(loaded_at) - 1) / 6) AS p FROM refs), ep AS (SELECT k, since, floor((year(since) * 12 + month(since) - 1) / 6) AS p, floor((year(until) * 12 + month(until) - 1) / 6) AS gone FROM parents),
        periods AS (SELECT DISTINCT p AS t FROM (SELECT p FROM rp UNION SELECT p FROM ep UNION SELECT gone FROM ep WHERE gone IS NOT NULL)),
        counted AS (SELECT t, k, since, count(*) FILTER (p <= t) AS n_rows, count(*) FILTER (p <= t) - count(*) FILTER (gone <= t) AS n_live FROM ep, periods WHERE p <= t OR gone <= t GROUP BY t, k, since),
        state AS (SELECT t, k, sum(n_rows) AS n_rows, min(since) FILTER (n_live > 0) AS first_live FROM counted GROUP BY t, k),
        cases AS (SELECT periods.t, ref_table, ref_field, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS ref_month, CASE WHEN coalesce(n_rows, 0) = 0 THEN 'missing' WHEN first_live IS NULL THEN 'deleted' WHEN first_live > loaded_at THEN 'late' END AS ref_state
          FROM rp JOIN periods ON rp.p <= periods.t LEFT JOIN state ON state.t = periods.t AND state.k = rp.k)
        SELECT printf('%04d-%02d', floor(t * 6 / 12)::INT, (t * 6 % 12 + 1)::INT) AS period, ref_table, ref_field, ref_month, ref_state, count(*) AS n_refs FROM cases WHERE ref_state IS NOT NULL GROUP BY ALL""",
    "p4_found": f"WITH {P4_DOCS} SELECT file_no FROM kept",
    "p4_layout": f"WITH {P4_DOCS} SELECT kind, count(*) AS n_docs, sum(length(body))::BIGINT AS n_chars FROM kept GROUP BY kind",
}
