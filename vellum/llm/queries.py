"""Queries of the training-data operators in this package, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.keys import plain_patent
from vellum.llm import capping, clusters, leakage, packing, sentences, splits
from vellum.session import table, written

#: Rank file of the public tokenizer where ``spark.vellum.vocabulary`` names no other.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.patent_groups(table(spark, sf_dir, "results").select("load_no", "patent_id", "sketch_id"))
    return splits.mixed_groups(rows, "patent_id").select("load_no", F.col("group_key").alias("lead_patent"))


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its group and split, stratified by status."""
    rows = splits.patent_groups(table(spark, sf_dir, "results").select("load_no", "patent_id", "sketch_id", "status"))
    return splits.split_rows(rows, "status").select("load_no", "group_key", "split")


def p2_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and groups per split and status."""
    rows = splits.patent_groups(table(spark, sf_dir, "results").select("load_no", "patent_id", "sketch_id", "status"))
    return splits.split_rows(rows, "status").groupBy("split", "status").agg(F.count("*").alias("n_rows"), F.countDistinct("group_key").alias("n_groups"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split and whether its share of all rows is within a hundredth of what it should be."""
    rows = splits.patent_groups(table(spark, sf_dir, "results").select("load_no", "patent_id", "sketch_id", "status"))
    counts = splits.split_rows(rows, "status").groupBy("split").agg(F.count("*").alias("n"))  # three rows
    wanted = spark.createDataFrame(list(zip(splits.SPLITS, splits.SHARES)), "split string, share double")
    return counts.join(wanted, "split").select("split", (F.abs(F.col("n") / F.sum("n").over(Window.partitionBy()) - F.col("share")) <= 0.01).alias("near"))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.families(table(spark, sf_dir, "filter_manifest"), "load_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_members(spark, sf_dir).where("lead <> row_key").select(F.col("lead").alias("lead_no"), F.col("row_key").alias("load_no"))


def p5_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family with its size and most typical pages."""
    return clusters.described(written(p5_members(spark, sf_dir).select("row_key", "x", "lead"), "family-members")).select(F.col("lead").alias("lead_no"), "size", F.array_join("typical", ",").alias("typical"))


def p6_state(spark: SparkSession, sf_dir: str) -> capping.CapState:
    return capping.capped(capping.scored(table(spark, sf_dir, "results"), plain_patent(F.col("patent_id")), "load_no", "s3_mean_conf", "loaded_at"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept of each patent if none may hold more than a thousandth of all."""
    rows = written(capping.scored(table(spark, sf_dir, "results"), plain_patent(F.col("patent_id")), "load_no", "s3_mean_conf", "loaded_at"), "cap-scored")
    kept = capping.capped(rows, capping.share_limit(rows, 0.001)).kept
    return kept.groupBy(F.col("contributor").alias("patent")).agg(F.count("*").alias("n_kept"), F.sum("row_id").alias("sum_no"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_state(spark, sf_dir).log().select(F.col("row_id").alias("load_no"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept rows with their place."""
    return p6_state(spark, sf_dir).kept.select(F.col("contributor").alias("patent"), F.col("row_id").alias("load_no"), "place")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), spark.conf.get("spark.vellum.vocabulary", VOCABULARY))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2 048 tokens with their documents."""
    return containers(spark, sf_dir)


def p7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is in a container, how often it begins there, and whether no container is over capacity."""
    each = containers(spark, sf_dir).select("n_tokens", F.explode("items").alias("i"))
    return each.groupBy(F.col("i.doc").alias("doc_id")).agg(F.count_if(F.col("i.piece") == 0).alias("n_begun"), (F.max("n_tokens") <= packing.CAPACITY).alias("fits"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers and the share of their room that is used."""
    boxes = containers(spark, sf_dir)
    return boxes.agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_tokens") / (F.count("*") * packing.CAPACITY)).alias("fill"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case with the number of words in its stretch and its place in the text."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_no").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each leaked item stands in."""
    return p8_leaks(spark, sf_dir).groupBy("item_no").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


def p9_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per document and their mean length."""
    return p9_found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.avg(F.col("end_pos") - F.col("start_pos")).alias("mean_chars"))


QUERIES = {f.__name__: f for f in (p2_found, p2_split, p2_balance, p2_shares, p5_found, p5_families, p6_found, p6_kept, p6_shares, p7_containers, p7_members, p7_fill, p8_found, p8_leaks, p8_items, p9_found, p9_lengths)}
PATENT = "left(upper(regexp_replace(patent_id, '[^A-Za-z0-9]', '', 'g')), 9)"
P2_GROUPS = f"""WITH RECURSIVE
own AS (SELECT load_no, patent_id, {PATENT} AS p, CASE WHEN regexp_matches(sketch_id, '^[A-Za-z]{{2}}[^A-Za-z0-9]*[0-9]{{7}}([^0-9]|$)') THEN left(upper(regexp_replace(sketch_id, '[^A-Za-z0-9]', '', 'g')), 9) END AS t FROM results),
ties AS (SELECT DISTINCT p AS a, t AS b FROM own WHERE t <> p UNION SELECT DISTINCT t, p FROM own WHERE t <> p),
reach AS (SELECT a, b FROM ties UNION SELECT reach.a, ties.b FROM reach JOIN ties ON reach.b = ties.a),
roots AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a),
rows AS (SELECT load_no, patent_id, coalesce(root, p) AS lead_patent FROM own LEFT JOIN roots ON p = a)"""
P6_RANKED = f"""WITH ranked AS (SELECT {PATENT} AS patent, load_no, row_number() OVER (PARTITION BY {PATENT} ORDER BY CASE WHEN s3_mean_conf BETWEEN 0 AND 1 THEN s3_mean_conf ELSE -1 END DESC, load_no) AS place FROM results)"""
P5_FAMILIES = """WITH RECURSIVE f AS (SELECT load_no, round(text_density * 10000)::INT AS a, long_lines AS b, round(skel_tiny_cc_frac * 10000)::INT AS c, round(line_diag_ratio * 10000)::INT AS d FROM filter_manifest
  WHERE text_density IS NOT NULL AND long_lines IS NOT NULL AND skel_tiny_cc_frac IS NOT NULL AND line_diag_ratio IS NOT NULL),
links AS MATERIALIZED (SELECT x.load_no AS p, y.load_no AS q FROM f x JOIN f y ON abs(x.a - y.a) <= 90 AND abs(x.b - y.b) <= 6 AND abs(x.c - y.c) <= 340 AND abs(x.d - y.d) <= 340 AND x.load_no <> y.load_no),
reach AS (SELECT load_no AS p, load_no AS q FROM f UNION SELECT reach.p, links.q FROM reach JOIN links ON reach.q = links.p),
leads AS (SELECT p AS load_no, min(q) AS lead_no FROM reach GROUP BY p)"""
ORACLES = {
    "p5_found": f"{P5_FAMILIES} SELECT lead_no, load_no FROM leads WHERE lead_no <> load_no",
    "p2_shares": "SELECT unnest(['train', 'validation', 'test']) AS split, true AS near",
    "p5_families": f"""{P5_FAMILIES}, m AS (SELECT lead_no, f.* FROM leads JOIN f USING (load_no)), c AS (SELECT lead_no, count(*) AS size, avg(a) AS ca, avg(b) AS cb, avg(c) AS cc, avg(d) AS cd FROM m GROUP BY lead_no),
        o AS (SELECT lead_no, size, load_no, row_number() OVER (PARTITION BY lead_no ORDER BY round(((a - ca) / 90) ** 2 + ((b - cb) / 6) ** 2 + ((c - cc) / 340) ** 2 + ((d - cd) / 340) ** 2, 9), load_no) AS r FROM m JOIN c USING (lead_no))
        SELECT lead_no, any_value(size) AS size, string_agg(load_no, ',' ORDER BY r) AS typical FROM o WHERE r <= 3 GROUP BY lead_no""",
    "p6_shares": f"{P6_RANKED} SELECT patent, count(*) AS n_kept, sum(load_no)::BIGINT AS sum_no FROM ranked WHERE place <= greatest(1, (SELECT floor(count(*) * 0.001) FROM results)) GROUP BY patent",
    "p7_members": "SELECT doc_id, count(*) AS n_begun, true AS fits FROM documents GROUP BY doc_id",
    "p2_found": f"{P2_GROUPS} SELECT load_no, lead_patent FROM rows WHERE lead_patent IN (SELECT lead_patent FROM rows GROUP BY 1 HAVING count(DISTINCT patent_id) > 1)",
    "p6_found": f"{P6_RANKED} SELECT load_no FROM ranked WHERE place > 10",
    "p6_kept": f"{P6_RANKED} SELECT patent, load_no, place::INT AS place FROM ranked WHERE place <= 10",
}
