"""Every step of the rule chains on its threshold and just beyond it; expectations are written by hand."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import rules

BASE = {"letter_code": "F", "text_density": 0.02, "n_cc": 60, "large_cc_frac": 0.3, "long_lines": 1, "line_hv_ratio": 0.5, "line_diag_ratio": 0.5, "skel_tiny_cc_frac": 0.1, "skel_median_cc_area": 5.0, "skel_n_cc": 60}
SHORT = {"dens": "text_density", "large": "large_cc_frac", "lines": "long_lines", "hv": "line_hv_ratio", "diag": "line_diag_ratio", "tiny": "skel_tiny_cc_frac", "med": "skel_median_cc_area", "skel": "skel_n_cc", "code": "letter_code", "n": "n_cc"}
REST = "drawing/sparse_ambiguous_drawing"
LINES = "drawing/long_engineering_lines"
#: Features, what they give, the one that is moved, what that gives.
PAGES = [
    ({"code": "C"}, "discard/letter_c_chemistry", {"code": "E"}, REST),
    ({"code": "D"}, "discard/letter_d_text_or_formula", {"code": ""}, REST),
    ({"skel": 4000, "tiny": 0.9}, "discard/halftone_many_tiny_components", {"skel": 3999}, "discard/fragmented_tiny_skeleton_components"),
    ({"dens": 0.22}, "discard/too_dense_for_clean_cad", {"dens": 0.2199}, REST),
    ({"dens": 0.18, "large": 0.75}, "discard/dense_hatch_or_filled_region", {"large": 0.7499}, REST),
    ({"dens": 0.1, "n": 1500}, "discard/dense_text_or_flowchart", {"n": 1499}, "discard/many_connected_components"),
    ({"skel": 1000, "tiny": 0.7}, "discard/fragmented_tiny_skeleton_components", {"tiny": 0.6999}, REST),
    ({"lines": 10, "hv": 0.95, "diag": 0.03}, "discard/orthogonal_text_table_or_flowchart", {"diag": 0.0301}, LINES),
    ({"n": 180, "med": 12.0, "large": 0.7499}, "discard/text_heavy_plot_table_or_block_diagram", {"large": 0.75}, REST),
    ({"n": 120, "large": 0.85, "diag": 0.12}, "discard/block_diagram_text_boxes", {"diag": 0.1199}, REST),
    ({"n": 120, "large": 0.85, "diag": 0.45}, "discard/block_diagram_text_boxes", {"diag": 0.4501}, REST),
    ({"n": 350, "diag": 0.08, "tiny": 0.55, "hv": 0.85}, "discard/chart_or_axis_plot", {"hv": 0.8499}, "discard/text_box_circuit_or_block_diagram"),
    ({"n": 350, "diag": 0.08, "tiny": 0.55, "lines": 150}, "discard/chart_or_axis_plot", {"lines": 149}, LINES),
    ({"n": 120, "lines": 70, "large": 0.84, "diag": 0.22, "med": 15.0, "tiny": 0.4}, "discard/plot_or_flowchart", {"lines": 69}, LINES),
    ({"n": 70, "lines": 35, "large": 0.75, "diag": 0.45, "med": 20.0, "tiny": 0.25}, "discard/sparse_scientific_plot", {"med": 19.99}, LINES),
    ({"n": 119, "lines": 3, "large": 0.75, "diag": 0.45, "med": 20.0, "tiny": 0.25}, "discard/sparse_scientific_plot", {"n": 120}, LINES),
    ({"n": 80, "lines": 20, "large": 0.9, "diag": 0.1, "med": 35.0, "tiny": 0.1}, "discard/single_axis_curve_plot", {"tiny": 0.1001}, LINES),
    ({"n": 300, "large": 0.65, "diag": 0.2, "med": 6.0, "dens": 0.05, "tiny": 0.6}, "discard/multi_panel_scientific_plot", {"dens": 0.0501}, REST),
    ({"n": 90, "large": 0.7, "hv": 0.8, "diag": 0.16, "med": 12.0, "tiny": 0.25, "dens": 0.05}, "discard/scientific_line_plot", {"hv": 0.7999}, REST),
    ({"n": 220, "large": 0.88, "hv": 0.8, "diag": 0.1, "med": 12.0, "tiny": 0.25, "dens": 0.05}, "discard/scientific_line_plot", {"n": 221}, REST),
    ({"n": 220, "large": 0.75, "hv": 0.8, "diag": 0.18, "tiny": 0.45}, "discard/text_box_circuit_or_block_diagram", {"tiny": 0.4499}, REST),
    ({"lines": 2, "large": 0.0499, "dens": 0.03}, "discard/text_or_formula_snippet", {"large": 0.05}, REST),
    ({"lines": 3}, LINES, {"lines": 2}, REST),
    ({"n": 501}, "discard/many_connected_components", {"n": 500}, REST),
    ({"large": 0.4001, "lines": 0}, "discard/compact_chemistry_blob", {"large": 0.4}, REST),
    ({"dens": 0.0079}, "discard/near_blank", {"dens": 0.008}, REST),
]


def named(values):
    return {SHORT[k]: v for k, v in values.items()}


def outcomes(spark, cases, base, steps, otherwise):
    rows = [base | c for c in cases]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for c, v in base.items()))
    return [r[0] for r in df.select(rules.first_match(steps, otherwise)).collect()]


def test_every_class_of_pages(spark):
    on = outcomes(spark, [named(c) for c, *_ in PAGES], BASE, rules.PAGE_CLASSES, rules.PAGE_ELSE)
    off = outcomes(spark, [named(c | moved) for c, _, moved, _ in PAGES], BASE, rules.PAGE_CLASSES, rules.PAGE_ELSE)
    assert on == [w for _, w, _, _ in PAGES] and off == [w for *_, w in PAGES]
    assert {w for _, w, *_ in PAGES} | {REST} == {s.gives for s in rules.PAGE_CLASSES} | {rules.PAGE_ELSE}


CONTENT = [
    ({"n": 110, "lines": 5, "large": 0.35, "hv": 0.90, "diag": 0.04, "med": 28.0}, "sparse_hv_block_or_ui", {"med": 27.9}, None),
    ({"n": 80, "lines": 15, "large": 0.55, "hv": 0.80, "diag": 0.06, "tiny": 0.20, "med": 14.0}, "chemistry_formula_grid", {"n": 79}, None),
    ({"n": 280, "lines": 12, "large": 0.55, "med": 10.0, "dens": 0.05}, "sparse_formula_or_symbol_grid", {"n": 281}, None),
    ({"n": 80, "lines": 40, "large": 0.5, "hv": 0.84, "diag": 0.13, "dens": 0.015}, "orthogonal_block_flow_or_chart", {"dens": 0.0149}, None),
    ({"n": 300, "lines": 50, "diag": 0.55, "med": 12.0, "dens": 0.06}, "diagonal_lattice_network_diagram", {"lines": 49}, None),
    ({"dens": 0.055, "lines": 120, "hv": 0.75, "diag": 0.08}, "dense_hv_chart_or_hatching", {"lines": 119}, None),
    ({"dens": 0.08, "lines": 80, "diag": 0.08}, "dense_bar_chart_or_table", {"lines": 79}, None),
    ({"dens": 0.07, "n": 100, "lines": 20}, "dense_chart_hatching_or_barplot", {"n": 99}, None),
    ({"n": 450, "tiny": 0.25, "med": 12.0, "dens": 0.08}, "dense_label_or_plot_page", {"n": 449}, None),
    ({"dens": 0.065, "n": 100, "large": 0.9, "lines": 20}, "dense_small_chart_or_symbol_page", {"lines": 19}, None),
    ({"n": 130, "lines": 25, "large": 0.65, "diag": 0.65, "med": 14.0, "dens": 0.04}, "sparse_diagonal_axis_plot", {"n": 131}, None),
    ({"n": 180, "lines": 10, "large": 0.6, "med": 20.0, "dens": 0.055, "diag": 0.3, "hv": 0.2}, "sparse_curve_axis_or_timing_plot", {"diag": 0.2999}, None),
    ({"n": 260, "lines": 20, "large": 0.62, "tiny": 0.12, "med": 15.0, "dens": 0.055, "diag": 0.7, "hv": 0.6}, "text_axis_or_legend_plot", {"n": 261}, None),
]


def test_content_rules(spark):
    base = {k: v for k, v in BASE.items() if k != "letter_code"} | {"large_cc_frac": 0.3}
    on = outcomes(spark, [named(c) for c, *_ in CONTENT], base, rules.CONTENT, None)
    off = outcomes(spark, [named(c | moved) for c, _, moved, _ in CONTENT], base, rules.CONTENT, None)
    assert on == [w for _, w, *_ in CONTENT] and off == [w for *_, w in CONTENT]
    assert len(rules.CONTENT) == 45 and len({s.gives for s in rules.CONTENT}) == 45


RUN = {"total_time": 9.99, "s2_n_edges": 50, "s2_micro_edge_ratio": 0.279, "s2_short_edge_ratio": 0.699, "s3_low_conf_ratio": 0.219, "s3_mean_conf": 0.67}


@pytest.mark.parametrize("column,value,want", [("total_time", 10.0, "slow_outlier"), ("s2_n_edges", 49, "too_sparse"), ("s2_n_edges", 699, "keep"), ("s2_n_edges", 700, "too_complex"), ("s2_micro_edge_ratio", 0.28, "too_fragmented_micro_edges"), ("s2_short_edge_ratio", 0.7, "too_fragmented_short_edges"), ("s3_low_conf_ratio", 0.22, "too_many_low_conf_primitives"), ("s3_mean_conf", 0.6699, "low_mean_primitive_confidence"), ("s3_mean_conf", 0.67, "keep")])
def test_manifest_gates(spark, column, value, want):
    assert outcomes(spark, [{column: value}], RUN, rules.MANIFEST_GATES, "keep") == [want]


GATE = {"s1_flagged": 0, "s2_flagged": 0, "s3_flagged": 0, "s3_n_primitives": 900, "s3_low_conf_ratio": 0.25, "s2_n_hachure_edges_removed": 19}


@pytest.mark.parametrize("change,want", [({}, "passed"), ({"s1_flagged": 1, "s2_flagged": 1}, "stage1"), ({"s2_flagged": 1}, "stage2"), ({"s3_flagged": 1}, "stage3"), ({"s3_n_primitives": 901}, "stage3"), ({"s3_low_conf_ratio": 0.2501}, "stage3"), ({"s3_low_conf_ratio": 0.65, "s2_n_hachure_edges_removed": 20}, "passed"), ({"s3_low_conf_ratio": 0.6501, "s2_n_hachure_edges_removed": 20}, "stage3")])
def test_gates_between_stages(spark, change, want):
    assert outcomes(spark, [change], GATE, rules.stage_gate(), "passed") == [want]
    open_gates = outcomes(spark, [change], GATE, rules.stage_gate(0, 0), "passed")[0]
    assert open_gates == (want if any(k.endswith("flagged") for k in change) else "passed")


FLAGS = {"s1_quality": 0.7, "s2_isolation": 0.3, "s2_n_edges": 2500, "s2_n_closed_edges": 2451, "s2_micro_edge_ratio": 0.9, "s2_short_edge_ratio": 0.9, "s3_mean_conf": 0.6, "s2_n_hachure_edges_removed": 19, "s4_n_in": 5, "s4_n_out": 5}


@pytest.mark.parametrize("change,want", [({}, None), ({"s1_quality": 0.6999}, "low_quality"), ({"s2_isolation": 0.3001}, "messy_graph"), ({"s2_n_edges": 2501, "s2_n_closed_edges": 2501}, "messy_graph"), ({"s2_n_closed_edges": 2450}, "messy_graph"), ({"s2_n_closed_edges": 2450, "s2_micro_edge_ratio": 0.5, "s2_short_edge_ratio": 0.8}, None), ({"s3_mean_conf": 0.5999}, "weak_fit"), ({"s3_mean_conf": 0.5, "s2_n_hachure_edges_removed": 20}, None), ({"s4_n_out": 4}, "lost_primitives")])
def test_flags_of_stages(spark, change, want):
    row = FLAGS | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'double' if isinstance(v, float) else 'int'}" for c, v in FLAGS.items()))
    got = df.select(*[F.expr(c).alias(n) for n, c in rules.STAGE_FLAGS.items()]).first().asDict()
    assert [n for n, v in got.items() if v] == ([want] if want else [])
