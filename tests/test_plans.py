"""What the physical plans must and must not hold."""

import datetime as dt
import re

import pytest

from vellum.operators import nested
from vellum.plans import chain_queries, corpus_queries, data_queries, export_queries, geometry_queries

NOW = dt.datetime(2025, 3, 1)
SCHEMAS = {
    "filter_manifest": "load_no bigint, loaded_at timestamp, removed_at timestamp, path string, patent string, filename string, letter_code string, label string, reason string, text_density double, n_cc int, large_cc_frac double, long_lines int, line_hv_ratio double, line_diag_ratio double, line_median_length double, skel_density double, skel_n_cc int, skel_tiny_cc_frac double, skel_median_cc_area double",
    "results": "load_no bigint, loaded_at timestamp, patent_id string, sketch_id string, input_path string, status string, error string, total_time double, completed_at string, s1_flagged int, s2_flagged int, s3_flagged int, s2_n_edges int, s2_micro_edge_ratio double, s2_short_edge_ratio double, s3_low_conf_ratio double, s3_mean_conf double, s3_n_primitives int",
    "training_manifest": "load_no bigint, loaded_at timestamp, patent_id string, sketch_id string, graph_path string, svg_path string",
    "artifact_files": "file_no bigint, path string, kind string, patent_id string, size_bytes bigint, created_at timestamp, deleted_at timestamp, body string",
    "primitive_docs": "doc_no bigint, patent_id string, sketch_id string, received_at timestamp, payload string",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Empty tables with all columns."""
    root = tmp_path_factory.mktemp("tables")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark, folder):
    text = plan(corpus_queries.page_class_counts(spark, folder))
    assert "filename" not in text and "removed_at" not in text and "skel_density" not in re.search(r"ReadSchema: (.*)", text)[1]
    text = plan(nested.shred(spark.read.parquet(f"{folder}/primitive_docs.parquet")))
    assert "Exchange" not in text and re.search(r"PushedFilters: \[IsNotNull\(payload\)\]", text) and "struct<doc_no:bigint,payload:string>" in text


@pytest.mark.parametrize("name", ["chain_lengths", "chain_directions", "line_fits", "circle_fits", "straight_or_round", "chain_types", "angular_gaps", "noise_loops", "line_like_chains", "encoded_chains", "vertex_kinds", "chain_statistics"])
def test_chains_are_parsed_once_and_fits_need_no_shuffle(spark, folder, name):
    text = plan(chain_queries.QUERIES[name](spark, folder))
    assert text.count("MapInArrow") == 1 and (name in ("vertex_kinds", "chain_statistics") or "Exchange" not in text)


def test_one_shuffle_for_one_aggregate(spark, folder):
    assert plan(corpus_queries.page_class_counts(spark, folder)).count("Exchange hashpartitioning") == 1
    assert plan(corpus_queries.paired_runs(spark, folder)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["curated_runs", "runs_not_discarded", "pages_to_run", "patent_sets", "sketch_views", "upserted_runs"])
def test_joins_are_on_keys(spark, folder, name):
    df = corpus_queries.QUERIES[name](spark, folder)
    assert not re.search("Cartesian|NestedLoop", plan(df)) and df.count() == 0


GEOMETRY = geometry_queries.QUERIES | chain_queries.QUERIES | export_queries.QUERIES


@pytest.mark.parametrize("name", sorted(set(GEOMETRY) - {"zero_shot", "stage_attribution"}))
def test_geometry_on_empty_tables(spark, folder, name):
    df = GEOMETRY[name](spark, folder)
    assert not re.search("Cartesian|NestedLoop", plan(df)) and df.count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_variants", "p3_found", "p3_report", "p3_snapshots", "p4_found"])
def test_general_operators_on_empty_tables(spark, folder, name):
    assert data_queries.QUERIES[name](spark, folder).count() == 0
