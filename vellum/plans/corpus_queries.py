"""Queries of the corpus layer: classification, joins, aggregates, ranks and samples, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.keys import last_part, plain_patent, run_path
from vellum.operators import aggregates as agg
from vellum.operators import relational as rel
from vellum.operators.rules import CONTENT, CONTENT_FEATURES, MANIFEST_GATES, PAGE_CLASSES, PAGE_ELSE, STAGE_FLAGS, UNREADABLE, as_sql, first_match, stage_gate, with_zeros
from vellum.session import fresh_path, table
from vellum.sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PAT = "left(upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')), 9)".format
NAME = r"regexp_extract(trim(input_path), '([^/\\]*)$', 1)"
CLASS = as_sql([UNREADABLE, *PAGE_CLASSES], PAGE_ELSE)
SKETCH = f"SELECT *, {PAT('patent_id')} AS plain FROM results"
LAST_PAGE = f"SELECT * FROM (SELECT *, {PAT('patent')} AS plain FROM filter_manifest) QUALIFY row_number() OVER (PARTITION BY plain, filename ORDER BY load_no DESC) = 1"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filter_manifest").withColumn("plain", plain_patent(F.col("patent")))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").withColumn("plain", plain_patent(F.col("patent_id")))


def last_pages(spark: SparkSession, d: str) -> DataFrame:
    return rel.keep_last(pages(spark, d), ["plain", "filename"], "load_no")


# --- scans, paths and rule chains


@query(r"SELECT load_no, upper(regexp_extract(filename, '(?i)_([A-Z])\d+\.tif$', 1)) AS code, regexp_replace(filename, '\.[^.]*$', '') AS stem, lower(regexp_extract(filename, '\.([^.]*)$', 1)) AS suffix, list_extract(string_split(path, '/'), -2) AS folder FROM filter_manifest")
def page_names(spark, d):
    """Letter code, stem, suffix and folder of every page."""
    name = F.col("filename")
    code = F.upper(F.regexp_extract(name, r"(?i)_([A-Z])\d+\.tif$", 1))
    return table(spark, d, "filter_manifest").select("load_no", code.alias("code"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"), F.element_at(F.split("path", "/"), -2).alias("folder"))


@query(f"SELECT load_no, split_part({CLASS}, '/', 1) AS page_label, split_part({CLASS}, '/', 2) AS page_reason FROM filter_manifest")
def page_classes(spark, d):
    """First-match classification of every page by its features."""
    both = F.split(first_match([UNREADABLE, *PAGE_CLASSES], PAGE_ELSE), "/")
    return table(spark, d, "filter_manifest").select("load_no", both[0].alias("page_label"), both[1].alias("page_reason"))


@query(f"SELECT {CLASS} AS page_class, count(*) AS n_pages FROM filter_manifest GROUP BY 1")
def page_class_counts(spark, d):
    """Histogram of the classes."""
    return table(spark, d, "filter_manifest").groupBy(first_match([UNREADABLE, *PAGE_CLASSES], PAGE_ELSE).alias("page_class")).agg(F.count("*").alias("n_pages"))


@query("SELECT load_no, " + ", ".join(f"coalesce(({c}), false) AS {n}" for n, c in STAGE_FLAGS.items()) + f", {as_sql(stage_gate(), 'passed')} AS gate, {as_sql(stage_gate(0, 0), 'passed')} AS open_gate FROM results")
def stage_gates(spark, d):
    """Flags of the stages and the first gate that a run fails, with limits and with all limits off."""
    flags = [F.coalesce(F.expr(c), F.lit(False)).alias(n) for n, c in STAGE_FLAGS.items()]
    return table(spark, d, "results").select("load_no", *flags, first_match(stage_gate(), "passed").alias("gate"), first_match(stage_gate(0, 0), "passed").alias("open_gate"))


# --- joins


ZEROS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in CONTENT_FEATURES)


@query(f"SELECT load_no, {as_sql(CONTENT)} AS content FROM (SELECT load_no, {ZEROS} FROM filter_manifest)")
def page_contents(spark, d):
    """What each page shows by the chain of content rules, or null."""
    return with_zeros(table(spark, d, "filter_manifest"), CONTENT_FEATURES).select("load_no", first_match(CONTENT).alias("content"))


@query(f"""WITH last AS ({LAST_PAGE}), files AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(trim(replace(path, '\\', '/')), '/(\\./)+', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\\.\\./', '/', 'g') AS p FROM artifact_files WHERE deleted_at IS NULL),
have AS (SELECT regexp_extract(p, '(?:^|.*/)runs/corpus_gated/(.*)$', 1) AS k FROM files),
zeros AS (SELECT load_no, {ZEROS} FROM filter_manifest), shown AS (SELECT load_no, {as_sql(CONTENT)} AS content FROM zeros),
joined AS (SELECT r.*, l.load_no AS page_no, l.reason AS page_reason, l.label AS page_label, shown.content, CASE WHEN r.plain || '/graphs/' || sketch_id || '_graph.json' NOT IN (SELECT k FROM have) THEN 'missing_graph'
  WHEN r.plain || '/primitives/' || sketch_id || '_primitives.json' NOT IN (SELECT k FROM have) THEN 'missing_primitives' WHEN r.plain || '/vectors/' || sketch_id || '.svg' NOT IN (SELECT k FROM have) THEN 'missing_svg' END AS absent
FROM ({SKETCH}) r LEFT JOIN last l ON r.plain = l.plain AND {NAME} = l.filename LEFT JOIN shown ON shown.load_no = l.load_no)
SELECT load_no, page_no, CASE WHEN status <> 'ok' THEN 'pipeline_' || status WHEN page_label IS DISTINCT FROM 'drawing' THEN 'filter_' || coalesce(page_label, 'missing') WHEN page_reason <> 'long_engineering_lines' THEN 'filter_' || page_reason
  WHEN NOT starts_with(upper(sketch_id), 'F') THEN 'non_figure_letter_code' WHEN absent IS NOT NULL THEN absent WHEN content IS NOT NULL THEN content ELSE {as_sql(MANIFEST_GATES, 'keep')} END AS curation FROM joined""")
def curated_runs(spark, d):
    """Runs with the last manifest row of their page: the first artefact that is missing, what the page shows, and the first gate that they fail."""
    last = with_zeros(last_pages(spark, d), CONTENT_FEATURES)
    last = last.select("plain", F.col("filename").alias("name"), F.col("load_no").alias("page_no"), F.col("reason").alias("page_reason"), F.col("label").alias("page_label"), first_match(CONTENT).alias("content"))
    have = table(spark, d, "artifact_files").where("deleted_at is null").select(run_path(F.col("path")).alias("k")).distinct()
    rows = runs(spark, d).withColumn("name", last_part(F.col("input_path"))).join(last, ["plain", "name"], "left")
    # one row per artefact, probed by one join
    ends = enumerate([("graphs", "_graph.json"), ("primitives", "_primitives.json"), ("vectors", ".svg")])
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.concat("plain", F.lit(f"/{folder}/"), "sketch_id", F.lit(end)).alias("k")) for i, (folder, end) in ends])
    absent = rows.where("status = 'ok'").select("load_no", F.explode(wanted).alias("w")).select("load_no", "w.*").join(have, "k", "left_anti").groupBy("load_no").agg(F.min("i").alias("i"))
    rows = rows.join(absent, "load_no", "left").withColumn("absent", F.get(F.array(F.lit("missing_graph"), F.lit("missing_primitives"), F.lit("missing_svg")), F.col("i")))
    stage = F.when(F.col("status") != "ok", F.concat(F.lit("pipeline_"), "status"))
    page = F.when(F.coalesce(F.col("page_label"), F.lit("")) != "drawing", F.concat(F.lit("filter_"), F.coalesce("page_label", F.lit("missing"))))
    page = page.when(F.col("page_reason") != "long_engineering_lines", F.concat(F.lit("filter_"), "page_reason"))
    code = F.when(~F.upper("sketch_id").startswith("F"), F.lit("non_figure_letter_code"))
    return rows.select("load_no", "page_no", F.coalesce(stage, page, code, F.col("absent"), F.col("content"), first_match(MANIFEST_GATES, "keep")).alias("curation"))


@query(f"SELECT r.load_no FROM ({SKETCH}) r WHERE NOT EXISTS (SELECT 1 FROM ({LAST_PAGE}) l WHERE l.label = 'discard' AND l.plain = r.plain AND l.filename = {NAME})")
def runs_not_discarded(spark, d):
    """Runs whose page is not discarded; unreadable and unlisted pages stay."""
    discard = last_pages(spark, d).where("label = 'discard'").select("plain", F.col("filename").alias("name"))
    return rel.unseen(runs(spark, d).withColumn("name", last_part(F.col("input_path"))), discard, ["plain", "name"]).select("load_no")


@query(f"SELECT DISTINCT plain, filename AS name FROM ({LAST_PAGE}) l WHERE label = 'drawing' AND NOT EXISTS (SELECT 1 FROM ({SKETCH}) r WHERE r.plain = l.plain AND {NAME} = l.filename)")
def pages_to_run(spark, d):
    """Drawings that have no run yet: what a resumed batch takes up."""
    done = runs(spark, d).select("plain", last_part(F.col("input_path")).alias("name"))
    return rel.unseen(last_pages(spark, d).where("label = 'drawing'").select("plain", F.col("filename").alias("name")).distinct(), done, ["plain", "name"])


PAIRS = f"""r AS ({SKETCH}), k AS (SELECT plain, sketch_id, min(load_no) AS a, max(load_no) AS b FROM r WHERE status = 'ok' GROUP BY ALL HAVING min(load_no) < max(load_no)),
p AS (SELECT k.plain, k.sketch_id, x.total_time AS ta, y.total_time AS tb, x.s3_n_primitives AS na, y.s3_n_primitives AS nb FROM k JOIN r x ON x.load_no = a JOIN r y ON y.load_no = b)"""


@query(f"WITH {PAIRS} SELECT plain, sketch_id, round(tb - ta, 6) AS d_time, (nb - na)::INT AS d_primitives FROM p")
def paired_runs(spark, d):
    """First and last successful run of the sketches that have several: the paired differences."""
    return run_pairs(spark, d).select("plain", "sketch_id", F.round(F.col("tb") - F.col("ta"), 6).alias("d_time"), (F.col("nb") - F.col("na")).alias("d_primitives"))


@query(f"WITH {PAIRS} SELECT count(*) AS n_pairs, round(avg(tb - ta), 6) AS mean_delta, round(avg((nb > na)::INT), 6) AS more_rate, round(avg(nb / greatest(na, 1)), 6) AS mean_ratio FROM p")
def paired_summary(spark, d):
    """Mean paired difference, share of pairs with more primitives, and mean ratio."""
    more = (F.col("nb") > F.col("na")).cast("int")
    return run_pairs(spark, d).agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.col("tb") - F.col("ta")), 6).alias("mean_delta"), F.round(F.avg(more), 6).alias("more_rate"), F.round(F.avg(F.col("nb") / F.greatest("na", F.lit(1))), 6).alias("mean_ratio"))


def run_pairs(spark: SparkSession, d: str) -> DataFrame:
    """First and last run by one aggregation; no self join."""
    ok = runs(spark, d).where("status = 'ok'")
    run = F.struct("load_no", "total_time", "s3_n_primitives")
    ends = ok.groupBy("plain", "sketch_id").agg(F.min(run).alias("a"), F.max(run).alias("b")).where("a.load_no < b.load_no")
    return ends.select("plain", "sketch_id", F.col("a.total_time").alias("ta"), F.col("b.total_time").alias("tb"), F.col("a.s3_n_primitives").alias("na"), F.col("b.s3_n_primitives").alias("nb"))


@query(r"""SELECT DISTINCT m.patent_id, m.sketch_id, v.kind FROM training_manifest m, (VALUES ('graph'), ('primitives'), ('svg')) v(kind)
WHERE EXISTS (SELECT 1 FROM artifact_files f WHERE f.patent_id = m.patent_id AND f.kind = v.kind AND f.deleted_at IS NULL AND regexp_extract(trim(f.path), '([^/\\]*)$', 1) = m.sketch_id || CASE v.kind WHEN 'graph' THEN '_graph.json' WHEN 'primitives' THEN '_primitives.json' ELSE '.svg' END)""")
def sketch_views(spark, d):
    """Sketches times kinds, where the kind's file is there."""
    ends = {"graph": "_graph.json", "primitives": "_primitives.json", "svg": ".svg"}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.concat("sketch_id", F.lit(e)).alias("name")) for k, e in ends.items()]))
    wanted = table(spark, d, "training_manifest").select("patent_id", "sketch_id", kinds.alias("v")).select("patent_id", "sketch_id", "v.*").distinct()
    files = table(spark, d, "artifact_files").where("deleted_at is null").select("patent_id", "kind", last_part(F.regexp_replace("path", r"\s+$", "")).alias("name"))
    return wanted.join(files, ["patent_id", "kind", "name"], "left_semi").select("patent_id", "sketch_id", "kind")


# --- aggregates

MEANS = ["total_time", "s0_time", "s1_time", "s1_quality", "s2_time", "s2_n_nodes", "s2_n_edges", "s2_median_edge_len", "s2_micro_edge_ratio", "s2_short_edge_ratio", "s2_isolation", "s3_time", "s3_n_primitives", "s3_low_conf_ratio", "s4_time", "s0_removed_ink_ratio"]
MOST, FLAGS = ["s2_n_edges", "s3_n_primitives", "s3_low_conf_ratio"], ["s1_flagged", "s2_flagged", "s3_flagged", "s4_flagged"]


@query("SELECT count(*) AS n_all, count(*) FILTER (status = 'ok') AS n_ok, " + ", ".join(f"round(avg({c}) FILTER (status = 'ok'), 6) AS mean_{c}" for c in MEANS) + ", " + ", ".join(f"round(max({c}) FILTER (status = 'ok'), 6)::DOUBLE AS max_{c}" for c in MOST) + ", " + ", ".join(f"round(sum({c}) FILTER (status = 'ok')::DOUBLE / count(*) FILTER (status = 'ok'), 6) AS rate_{c}" for c in FLAGS) + " FROM results")
def run_summary(spark, d):
    """Totals, means, maxima and flag rates of all runs in one pass."""
    ok = F.col("status") == "ok"
    at = lambda c: F.when(ok, F.col(c))
    rates = [F.round(F.sum(at(c)).cast("double") / F.count_if(ok), 6).alias(f"rate_{c}") for c in FLAGS]
    return table(spark, d, "results").agg(F.count("*").alias("n_all"), F.count_if(ok).alias("n_ok"), *[F.round(F.avg(at(c)), 6).alias(f"mean_{c}") for c in MEANS], *[F.round(F.max(at(c)).cast("double"), 6).alias(f"max_{c}") for c in MOST], *rates)


@query("SELECT status, count(*) AS n_runs, round(sum(s3_flagged)::DOUBLE / count(*), 6) AS flag_rate FROM results GROUP BY status")
def status_counts(spark, d):
    """Runs and flag rate by status; runs without a flag stay in the denominator."""
    return table(spark, d, "results").groupBy("status").agg(F.count("*").alias("n_runs"), F.round(agg.flag_rate("s3_flagged"), 6).alias("flag_rate"))


@query("SELECT coalesce(s2_keypoint_src, CASE WHEN grouping(s2_keypoint_src) = 1 THEN '__ALL__' END) AS source, count(s2_isolation) AS n_values, round(avg(s2_isolation), 6) AS mean_value FROM results GROUP BY ROLLUP (s2_keypoint_src)")
def rollup_means(spark, d):
    """Mean per source of key points, with the grand total."""
    source = F.coalesce("s2_keypoint_src", F.when(F.grouping("s2_keypoint_src") == 1, F.lit("__ALL__")))
    return table(spark, d, "results").rollup("s2_keypoint_src").agg(source.alias("source"), F.count("s2_isolation").alias("n_values"), F.round(F.avg("s2_isolation"), 6).alias("mean_value")).select("source", "n_values", "mean_value")


@query("SELECT status, round(avg(total_time), 6) AS mean, round(quantile_cont(total_time, 0.5), 6) AS p50, round(quantile_cont(total_time, 0.95), 6) AS p95 FROM results GROUP BY status")
def linear_percentiles(spark, d):
    """Mean and interpolated percentiles; exact, from value counts."""
    p = F.percentile("total_time", F.array(F.lit(0.5), F.lit(0.95)))
    return table(spark, d, "results").groupBy("status").agg(F.round(F.avg("total_time"), 6).alias("mean"), p.alias("p")).select("status", "mean", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"))


@query("WITH s AS (SELECT list_sort(list(s2_isolation) FILTER (s2_isolation IS NOT NULL)) AS v FROM results) SELECT p::INT AS percent, v[(len(v) * p // 100 + 1)::INT] AS value FROM s, (VALUES (5), (50), (95)) t(p)")
def index_percentiles(spark, d):
    """Percentiles by index into the sorted values, over all runs."""
    return agg.index_percentile(table(spark, d, "results"), "s2_isolation", [5, 50, 95])


@query(f"""WITH c AS (SELECT label AS truth, split_part({CLASS}, '/', 1) AS guess FROM filter_manifest), k AS (SELECT DISTINCT truth AS label FROM c),
n AS (SELECT label, count(*) FILTER (truth = label AND guess = label) AS tp, count(*) FILTER (truth <> label AND guess = label) AS fp, count(*) FILTER (truth = label AND guess <> label) AS fn FROM c, k GROUP BY label)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM n""")
def class_scores(spark, d):
    """Precision, recall and F1 of the rule chain against the stored labels."""
    rows = table(spark, d, "filter_manifest").select(F.col("label").alias("truth"), F.split(first_match([UNREADABLE, *PAGE_CLASSES], PAGE_ELSE), "/")[0].alias("guess"))
    cells = rows.groupBy("truth", "guess").agg(F.count("*").alias("n"))
    hit = F.col("truth") == F.col("guess")
    none = F.lit(None).cast("bigint")
    cell = lambda label, tp, fp, fn: F.struct(F.col(label).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    miss = F.when(~hit, F.col("n"))
    each = cells.select(F.explode(F.array(cell("truth", F.when(hit, F.col("n")), none, miss), cell("guess", none, miss, none))).alias("c")).select("c.*")
    known = each.groupBy("label").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).where("tp + fn > 0")
    return agg.scores(known).select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH c AS (SELECT label AS truth, {CLASS} AS guess, count(*) AS n FROM filter_manifest GROUP BY ALL), t AS (SELECT truth, sum(n)::BIGINT AS support FROM c GROUP BY truth)
SELECT truth, support, round(sum(-n / support * ln(n / support) / ln({len(PAGE_CLASSES) + 2}.0)), 6) AS entropy FROM c JOIN t USING (truth) GROUP BY ALL""")
def confusion_entropy(spark, d):
    """Support and normalised entropy of what the rule chain gives each stored label."""
    cells = table(spark, d, "filter_manifest").groupBy(F.col("label").alias("truth"), first_match([UNREADABLE, *PAGE_CLASSES], PAGE_ELSE).alias("guess")).agg(F.count("*").alias("n"))
    return agg.normalised_entropy(cells, "truth", "n", len(PAGE_CLASSES) + 2)


SHARE_FLOORS = {"line": 0.45, "arc": 0.08, "circle": 0.08, "polyline": 0.10}


@query("""SELECT letter_code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () < f.least AS below FROM filter_manifest JOIN (VALUES ('F', 0.45), ('A', 0.08), ('B', 0.08), ('D', 0.10)) f(letter_code, least) USING (letter_code) GROUP BY letter_code, f.least""")
def class_shares(spark, d):
    """Share of each class among the classes that have a floor, and whether it is below it."""
    floors = spark.createDataFrame([(c, f) for c, f in zip("FABD", SHARE_FLOORS.values())], "letter_code string, least double")
    counts = table(spark, d, "filter_manifest").join(F.broadcast(floors), "letter_code").groupBy("letter_code", "least").agg(F.count("*").alias("n"))  # four rows
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select("letter_code", "n", F.round(share, 6).alias("share"), (share < F.col("least")).alias("below"))


STATUSES = ["ok", "stage0", "stage1", "stage2", "stage3", "stage4", "quality_gate_stage1", "quality_gate_stage2", "quality_gate_stage3"]


@query(f"""WITH k AS (SELECT unnest({STATUSES}) AS status), c AS (SELECT k.status, count(r.status) AS n FROM k LEFT JOIN results r USING (status) GROUP BY 1)
SELECT status, round(CASE WHEN n = 0 THEN 10.0 ELSE least((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n::DOUBLE), 10.0) END, 6)::DOUBLE AS weight FROM c""")
def inverse_weights(spark, d):
    """Inverse-frequency weights of all statuses; one that never occurs has the largest weight."""
    return agg.class_weights(table(spark, d, "results"), "status", STATUSES)


@query("SELECT reason, n_pages, row_number() OVER (ORDER BY n_pages DESC, reason)::INT AS place FROM (SELECT reason, count(*) AS n_pages FROM filter_manifest GROUP BY 1)")
def reason_histogram(spark, d):
    """Reasons from the most frequent down; their number is bounded by the rule chain."""
    counts = table(spark, d, "filter_manifest").groupBy("reason").agg(F.count("*").alias("n_pages"))
    return counts.select("reason", "n_pages", F.row_number().over(Window.orderBy(F.desc("n_pages"), "reason")).alias("place"))


# --- order, samples, set operations


@query(f"SELECT plain, load_no FROM ({SKETCH}) QUALIFY row_number() OVER (PARTITION BY plain ORDER BY sketch_id, load_no) = 1")
def first_sketches(spark, d):
    """First sketch of every patent; a minimum, combined on the map side."""
    return runs(spark, d).groupBy("plain").agg(F.min(F.struct("sketch_id", "load_no")).alias("m")).select("plain", F.col("m.load_no").alias("load_no"))


@query(f"WITH f AS (SELECT plain, load_no FROM ({SKETCH}) QUALIFY row_number() OVER (PARTITION BY plain ORDER BY md5(load_no || '|42')) = 1) SELECT plain, load_no FROM f ORDER BY md5(plain || '|42') LIMIT 200")
def sampled_patents(spark, d):
    """One sketch of each of 200 patents in seeded order."""
    seeded = lambda c: F.md5(F.concat(F.col(c).cast("string"), F.lit("|42")))
    one = runs(spark, d).groupBy("plain").agg(F.min_by("load_no", seeded("load_no")).alias("load_no"))
    return one.orderBy(seeded("plain")).limit(200)


TILES = "SELECT load_no, ntile(3) OVER (ORDER BY s3_n_primitives, load_no) AS bin FROM results WHERE s3_n_primitives IS NOT NULL"


@query(f"WITH t AS ({TILES}) SELECT bin::INT AS bin, load_no FROM t QUALIFY row_number() OVER (PARTITION BY bin ORDER BY md5(load_no::VARCHAR)) <= 20")
def tercile_sample(spark, d):
    """Twenty runs of each third by complexity, in seeded order."""
    rows, n = rel.ranked(table(spark, d, "results").where("s3_n_primitives is not null").select("load_no", "s3_n_primitives"), "s3_n_primitives", "load_no")
    tiled = rows.withColumn("bin", rel.tile(F.col("rank"), n, 3).cast("int"))
    placed = tiled.withColumn("place", F.row_number().over(Window.partitionBy("bin").orderBy(rel.in_order_of_hash("load_no"))))
    return placed.where("place <= 20").select("bin", "load_no")


TOP_MODES = {"slowest": "coalesce(total_time, 0) DESC", "high_micro": "coalesce(s2_micro_edge_ratio, 0) DESC", "worst_low_conf": "coalesce(s3_low_conf_ratio, 0) DESC", "small_conf": "coalesce(s3_mean_conf, 999) ASC", "dense": "coalesce(text_density, 0) DESC", "random": "md5(load_no || '|7') ASC"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, load_no, row_number() OVER (ORDER BY {o}, load_no)::INT AS place FROM training_manifest) WHERE place <= 12" for m, o in TOP_MODES.items()))
def sheet_rows(spark, d):
    """First twelve manifest rows in each of six orders; every one is a top-k, not a sort of all rows."""
    rows, out = table(spark, d, "training_manifest"), None
    for mode, order in TOP_MODES.items():
        expr, way = order.rsplit(" ", 1)
        key = F.md5(F.concat(F.col("load_no").cast("string"), F.lit("|7"))) if mode == "random" else F.expr(expr)
        top = rows.orderBy(key.desc() if way == "DESC" else key.asc(), "load_no").limit(12).select("load_no", key.alias("k"))
        placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("k") if way == "DESC" else F.asc("k"), "load_no"))).select(F.lit(mode).alias("mode"), "load_no", "place")
        out = placed if out is None else out.unionByName(placed)
    return out


@query(f"WITH o AS (SELECT *, {PAT('patent_id')} AS plain FROM results), a AS (SELECT plain, sketch_id, load_no, status FROM o WHERE loaded_at < TIMESTAMPTZ '2025-07-01 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY plain, sketch_id ORDER BY load_no DESC) = 1), b AS (SELECT plain, sketch_id, load_no, status FROM o WHERE loaded_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY plain, sketch_id ORDER BY load_no DESC) = 1) SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.plain = b.plain AND a.sketch_id = b.sketch_id)")
def upserted_runs(spark, d):
    """The results table after the second half-year replaced the rows of its sketches."""
    rows = runs(spark, d).select("plain", "sketch_id", "load_no", "status", F.unix_timestamp("loaded_at").alias("at"))
    half = [rel.keep_last(rows.where(c), ["plain", "sketch_id"], "load_no").drop("at") for c in ("at < 1751328000", "at >= 1751328000")]
    return rel.upsert(half[0], half[1], ["plain", "sketch_id"])


@query("SELECT load_no, 'page' AS origin, filename AS name, label, NULL::DOUBLE AS total_time FROM filter_manifest UNION ALL SELECT load_no, 'run', NULL, NULL, total_time FROM results")
def evolved_union(spark, d):
    """Two generations of a table with different columns as one."""
    old = table(spark, d, "filter_manifest").select("load_no", F.lit("page").alias("origin"), F.col("filename").alias("name"), "label")
    return old.unionByName(table(spark, d, "results").select("load_no", F.lit("run").alias("origin"), "total_time"), allowMissingColumns=True)


@query(f"WITH a AS (SELECT DISTINCT {PAT('patent_id')} AS p FROM results), b AS (SELECT DISTINCT {PAT('patent')} AS p FROM filter_manifest), c AS (SELECT DISTINCT patent_id AS p FROM training_manifest) SELECT 'both' AS part, p FROM a INTERSECT SELECT 'both', p FROM b UNION ALL SELECT 'only_runs', p FROM (SELECT p FROM a EXCEPT SELECT p FROM c)")
def patent_sets(spark, d):
    """Patents of runs that have pages, and patents of runs without a training row."""
    a, b = runs(spark, d).select("plain").distinct(), pages(spark, d).select("plain").distinct()
    c = table(spark, d, "training_manifest").select(F.col("patent_id").alias("plain"))
    both, only = a.join(b, "plain", "left_semi"), a.join(c, "plain", "left_anti")
    return both.select(F.lit("both").alias("part"), F.col("plain").alias("p")).unionByName(only.select(F.lit("only_runs").alias("part"), F.col("plain").alias("p")))


@query(r"""SELECT load_no, coalesce(TRY_CAST(regexp_extract(sketch_id, '(\d+)$', 1) AS INT), -1) AS number, coalesce(TRY_CAST(substr(completed_at, 18) AS DOUBLE), 0.0) AS bad, trunc(coalesce(s3_mean_conf, 0) * 10)::INT AS tenth, epoch(CAST(completed_at AS TIMESTAMPTZ))::BIGINT AS finished FROM results""")
def safe_casts(spark, d):
    """Numbers and times out of texts, with a default where a text is none; fractions are cut towards zero."""
    number = F.coalesce(F.regexp_extract("sketch_id", r"(\d+)$", 1).try_cast("int"), F.lit(-1))
    bad = F.coalesce(F.substring("completed_at", 18, 40).try_cast("double"), F.lit(0.0))
    tenth = (F.coalesce("s3_mean_conf", F.lit(0.0)) * 10).cast("int")
    return table(spark, d, "results").select("load_no", number.alias("number"), bad.alias("bad"), tenth.alias("tenth"), F.unix_timestamp(F.col("completed_at").cast("timestamp")).alias("finished"))


@query("""SELECT file_no, (body->>'$.image_shape[0]')::INT AS height, (body->>'$.image_shape[1]')::INT AS width, (body->>'$.metrics.median_edge_length')::DOUBLE AS median_edge, json_array_length(body->'nodes')::INT AS n_nodes
FROM artifact_files WHERE kind = 'graph' AND json_valid(body) AND json_type(body) = 'OBJECT'""")
def graph_headers(spark, d):
    """Fields of the graph documents; a broken document has no row."""
    shape = "struct<sketch_id:string,image_shape:array<int>,metrics:struct<median_edge_length:double>,nodes:array<struct<id:int>>,_bad:string>"
    doc = F.from_json("body", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = table(spark, d, "artifact_files").where("kind = 'graph' and trim(body) <> ''").select("file_no", doc.alias("g")).where("g._bad is null and g is not null")
    return rows.select("file_no", F.get("g.image_shape", F.lit(0)).alias("height"), F.get("g.image_shape", F.lit(1)).alias("width"), F.col("g.metrics.median_edge_length").alias("median_edge"), F.size("g.nodes").alias("n_nodes"))


# --- sources and sinks


@query("SELECT load_no, patent_id, coalesce(sketch_id, '') AS sketch_id, coalesce(svg_path, '') AS svg_path, coalesce(s2_n_edges, 0) AS n_edges, coalesce(s3_mean_conf, 0) AS mean_conf FROM training_manifest")
def manifest_file(spark, d):
    """The training manifest written as delimited text and read back, texts made numbers again."""
    path, fields = fresh_path(spark, "manifest-csv"), ["load_no", "patent_id", "sketch_id", "svg_path", "s2_n_edges", "s3_mean_conf", "absent"]
    sinks.write_csv(table(spark, d, "training_manifest"), path, fields)
    rows = readers.text_table(spark, path, fields)
    return rows.select(F.col("load_no").cast("bigint").alias("load_no"), "patent_id", F.coalesce("sketch_id", F.lit("")).alias("sketch_id"), F.coalesce("svg_path", F.lit("")).alias("svg_path"), readers.whole("s2_n_edges").alias("n_edges"), readers.number("s3_mean_conf").alias("mean_conf"))


@query("SELECT load_no, graph_path, filter_reason, total_time FROM training_manifest")
def manifest_lines(spark, d):
    """The training manifest written as JSON lines and read back."""
    path = fresh_path(spark, "manifest-json")
    sinks.write_json_lines(table(spark, d, "training_manifest").select("load_no", "graph_path", "filter_reason", "total_time"), path)
    return spark.read.schema("load_no bigint, graph_path string, filter_reason string, total_time double").json(path)


@query(r"SELECT load_no, path AS src, 'quarantine/' || patent || '/' || regexp_extract(trim(path), '([^/\\]*)$', 1) AS dst FROM filter_manifest WHERE label = 'discard'")
def quarantine(spark, d):
    """Where the discarded pages would be moved to."""
    rows = table(spark, d, "filter_manifest").where("label = 'discard'")
    return rows.select("load_no", F.col("path").alias("src"), F.concat_ws("/", F.lit("quarantine"), "patent", last_part(F.col("path"))).alias("dst"))


@query("SELECT load_no, 'page' AS origin, filename AS name, label, NULL::DOUBLE AS total_time FROM filter_manifest UNION ALL SELECT load_no, 'run', NULL, NULL, total_time FROM results")
def evolved_table(spark, d):
    """A stored table that is created once, gets a column later, and takes rows of both generations."""
    name, path = f"evolved_{uuid.uuid4().hex}", fresh_path(spark, "evolved")
    sinks.ensure_table(spark, name, {"load_no": "bigint", "origin": "string", "name": "string", "label": "string"}, path)
    sinks.append_rows(table(spark, d, "filter_manifest").select("load_no", F.lit("page").alias("origin"), F.col("filename").alias("name"), "label"), name)
    for _ in range(2):
        sinks.ensure_table(spark, name, {"load_no": "bigint", "total_time": "double"}, path)
    sinks.append_rows(table(spark, d, "results").select("load_no", F.lit("run").alias("origin"), "total_time"), name)
    rows = spark.table(name)
    out = spark.read.schema(rows.schema).parquet(path)
    spark.sql(f"DROP TABLE {name}")  # the rows stay in the shared folder
    return out


@query("SELECT load_no, patent_id, s2_n_edges AS n_edges, s3_mean_conf AS conf FROM training_manifest")
def run_documents(spark, d):
    """Every manifest row as a JSON document, and its fields read back."""
    own = table(spark, d, "training_manifest").select("load_no", "patent_id", "s2_n_edges", "s3_mean_conf")
    doc = F.from_json("body", "struct<patent_id:string,s2_n_edges:int,s3_mean_conf:double>")
    return sinks.json_documents(own, "load_no").select("load_no", doc.alias("d")).select("load_no", "d.patent_id", F.col("d.s2_n_edges").alias("n_edges"), F.col("d.s3_mean_conf").alias("conf"))


@query(r"""SELECT load_no FROM training_manifest m WHERE coalesce(s3_n_primitives, 1000000000) <= 150 AND EXISTS (SELECT 1 FROM artifact_files f WHERE f.deleted_at IS NULL AND f.kind = 'svg' AND f.patent_id = m.patent_id AND regexp_extract(trim(f.path), '([^/\\]*)$', 1) = m.sketch_id || '.svg')""")
def labelable_rows(spark, d):
    """Manifest rows that can be labelled: the drawing is there and has at most 150 primitives."""
    files = table(spark, d, "artifact_files").where("deleted_at is null and kind = 'svg'").select("patent_id", last_part(F.regexp_replace("path", r"\s+$", "")).alias("name"))
    rows = table(spark, d, "training_manifest").where("coalesce(s3_n_primitives, 1000000000) <= 150").withColumn("name", F.concat("sketch_id", F.lit(".svg")))
    return rows.join(files, ["patent_id", "name"], "left_semi").select("load_no")


LIMIT = 500


@query(f"""WITH first AS (SELECT DISTINCT plain, filename AS name FROM ({LAST_PAGE}) ORDER BY plain, name LIMIT {LIMIT})
SELECT plain, name FROM first f WHERE NOT EXISTS (SELECT 1 FROM ({LAST_PAGE}) l WHERE l.label = 'discard' AND l.plain = f.plain AND l.filename = f.name) AND NOT EXISTS (SELECT 1 FROM ({SKETCH}) r WHERE r.plain = f.plain AND {NAME} = f.name)""")
def limited_run(spark, d):
    """What a run limited to the first 500 pages takes up: the limit counts pages that are then discarded or done."""
    last = last_pages(spark, d).select("plain", F.col("filename").alias("name"), "label")
    done = runs(spark, d).select("plain", last_part(F.col("input_path")).alias("name"))
    return rel.limited_first(last.select("plain", "name").distinct(), ["plain", "name"], LIMIT, (last.where("label = 'discard'"), ["plain", "name"]), (done, ["plain", "name"]))


@query("WITH ids AS (SELECT DISTINCT patent_id FROM artifact_files ORDER BY md5(patent_id || '|42'), patent_id LIMIT 100) SELECT DISTINCT patent_id, kind FROM artifact_files WHERE deleted_at IS NULL AND patent_id IN (SELECT patent_id FROM ids)")
def sampled_views(spark, d):
    """The kinds of files of 100 patents in a seeded order."""
    return rel.sampled_ids(table(spark, d, "artifact_files"), "patent_id", 100, 42).where("deleted_at is null").select("patent_id", "kind").distinct()
