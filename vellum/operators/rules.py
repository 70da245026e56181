"""Ordered first-match rule chains as one CASE expression; they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """A condition in SQL over the columns of the table, and what it gives; a null condition does not hold."""

    when: str
    gives: str


def first_match(steps: Iterable[Step], otherwise: str | None = None) -> Column:
    """What the first step that holds gives, else ``otherwise``."""
    steps = list(steps)
    chain = F.when(F.expr(steps[0].when), steps[0].gives)
    for step in steps[1:]:
        chain = chain.when(F.expr(step.when), step.gives)
    return chain.otherwise(F.lit(otherwise))


def steps_of(table) -> list[Step]:
    """A chain from a table ``(place, condition, gives)``, say of a CSV; the chain is a stated list, its length is checked."""
    rows = table.select("place", "condition", "gives").orderBy("place").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a rule chain of more than 10,000 steps")
    return [Step(r["condition"], r["gives"]) for r in rows]


def as_sql(steps: Iterable[Step], otherwise: str | None = None) -> str:
    """The same chain as text."""
    end = "NULL" if otherwise is None else f"'{otherwise}'"
    return "CASE " + " ".join(f"WHEN {s.when} THEN '{s.gives}'" for s in steps) + f" ELSE {end} END"


#: Content classes of a page from its features.  Fixed values: conditions, labels and reasons in this order.
PAGE_CLASSES = [
    Step("letter_code = 'C'", "discard/letter_c_chemistry"),
    Step("letter_code = 'D'", "discard/letter_d_text_or_formula"),
    Step("skel_n_cc >= 4000 and skel_tiny_cc_frac >= 0.9", "discard/halftone_many_tiny_components"),
    Step("text_density >= 0.22", "discard/too_dense_for_clean_cad"),
    Step("text_density >= 0.18 and large_cc_frac >= 0.75", "discard/dense_hatch_or_filled_region"),
    Step("text_density >= 0.1 and n_cc >= 1500", "discard/dense_text_or_flowchart"),
    Step("skel_n_cc >= 1000 and skel_tiny_cc_frac >= 0.7", "discard/fragmented_tiny_skeleton_components"),
    Step("long_lines >= 10 and line_hv_ratio >= 0.95 and line_diag_ratio <= 0.03", "discard/orthogonal_text_table_or_flowchart"),
    Step("n_cc >= 180 and skel_median_cc_area >= 12.0 and large_cc_frac < 0.75", "discard/text_heavy_plot_table_or_block_diagram"),
    Step("n_cc >= 120 and large_cc_frac >= 0.85 and line_diag_ratio between 0.12 and 0.45", "discard/block_diagram_text_boxes"),
    Step("n_cc >= 350 and line_diag_ratio <= 0.08 and skel_tiny_cc_frac >= 0.55 and (line_hv_ratio >= 0.85 or long_lines >= 150)", "discard/chart_or_axis_plot"),
    Step("n_cc >= 120 and long_lines >= 70 and large_cc_frac <= 0.85 and line_diag_ratio <= 0.22 and skel_median_cc_area >= 15.0 and skel_tiny_cc_frac <= 0.4", "discard/plot_or_flowchart"),
    Step("n_cc >= 70 and n_cc < 120 and long_lines <= 35 and large_cc_frac <= 0.75 and line_diag_ratio <= 0.45 and skel_median_cc_area >= 20.0 and skel_tiny_cc_frac <= 0.25", "discard/sparse_scientific_plot"),
    Step("n_cc <= 80 and long_lines >= 20 and large_cc_frac >= 0.9 and line_diag_ratio <= 0.1 and skel_median_cc_area >= 35.0 and skel_tiny_cc_frac <= 0.1", "discard/single_axis_curve_plot"),
    Step("n_cc >= 300 and large_cc_frac <= 0.65 and line_diag_ratio between 0.2 and 0.45 and skel_median_cc_area >= 6.0 and text_density <= 0.05 and skel_tiny_cc_frac <= 0.6", "discard/multi_panel_scientific_plot"),
    Step("n_cc between 90 and 220 and large_cc_frac between 0.7 and 0.88 and line_hv_ratio >= 0.8 and line_diag_ratio <= 0.16 and skel_median_cc_area >= 12.0 and skel_tiny_cc_frac <= 0.25 and text_density <= 0.05", "discard/scientific_line_plot"),
    Step("n_cc >= 220 and large_cc_frac <= 0.75 and line_hv_ratio >= 0.8 and line_diag_ratio <= 0.18 and skel_tiny_cc_frac >= 0.45", "discard/text_box_circuit_or_block_diagram"),
    Step("long_lines < 3 and large_cc_frac < 0.05 and text_density >= 0.03", "discard/text_or_formula_snippet"),
    Step("long_lines >= 3", "drawing/long_engineering_lines"),
    Step("n_cc > 500", "discard/many_connected_components"),
    Step("large_cc_frac > 0.4 and long_lines = 0", "discard/compact_chemistry_blob"),
    Step("text_density < 0.008", "discard/near_blank"),
]
PAGE_ELSE = "drawing/sparse_ambiguous_drawing"
#: Pages that could not be read have no features at all.
UNREADABLE = Step("text_density is null and n_cc is null and long_lines is null", "error/load_error")

#: Flags of the stages.  Fixed values: the default limits of each stage.
STAGE_FLAGS = {
    "low_quality": "s1_quality < 0.70",
    "messy_graph": "s2_isolation > 0.30 or s2_n_edges > 2500 or (s2_n_edges - s2_n_closed_edges >= 50 and (s2_micro_edge_ratio > 0.50 or s2_short_edge_ratio > 0.80))",
    "weak_fit": "s3_mean_conf < case when s2_n_hachure_edges_removed >= 20 then 0.50 else 0.60 end",
    "lost_primitives": "s4_n_out < s4_n_in",
}
#: Gates between the stages (fixed values); a limit of 0 is no limit.
MAX_PRIMITIVES, MAX_LOW, MAX_LOW_HACHURE, HACHURE_EDGES = 900, 0.25, 0.65, 20


def stage_gate(max_primitives: int = MAX_PRIMITIVES, max_low: float = MAX_LOW) -> list[Step]:
    """First gate that a run fails."""
    limit = f"case when coalesce(s2_n_hachure_edges_removed, 0) >= {HACHURE_EDGES} then {max(max_low, MAX_LOW_HACHURE)} else {max_low} end"
    third = ["s3_flagged = 1"]
    third += [f"s3_n_primitives > {max_primitives}"] * (max_primitives > 0) + [f"s3_low_conf_ratio > {limit}"] * (max_low > 0)
    return [Step("s1_flagged = 1", "stage1"), Step("s2_flagged = 1", "stage2"), Step(" or ".join(third), "stage3")]


#: Numeric gates of the training manifest.  Fixed values.
MANIFEST_GATES = [
    Step("coalesce(total_time, 0) >= 10.0", "slow_outlier"),
    Step("coalesce(s2_n_edges, 0) < 50", "too_sparse"),
    Step("coalesce(s2_n_edges, 0) >= 700", "too_complex"),
    Step("coalesce(s2_micro_edge_ratio, 0) >= 0.28", "too_fragmented_micro_edges"),
    Step("coalesce(s2_short_edge_ratio, 0) >= 0.70", "too_fragmented_short_edges"),
    Step("coalesce(s3_low_conf_ratio, 0) >= 0.22", "too_many_low_conf_primitives"),
    Step("coalesce(s3_mean_conf, 0) < 0.67", "low_mean_primitive_confidence"),
]


#: What a page that is kept as a drawing shows after all: charts, tables, diagrams.  Fixed values: conditions and reasons in this order; features that
#: are missing count as 0, so the chain runs over ``with_zeros``.
CONTENT = [
    Step("n_cc <= 110 and long_lines >= 5 and large_cc_frac >= 0.35 and line_hv_ratio >= 0.90 and line_diag_ratio <= 0.04 and skel_median_cc_area >= 28.0", "sparse_hv_block_or_ui"),
    Step("n_cc between 80 and 220 and long_lines <= 15 and large_cc_frac >= 0.55 and line_hv_ratio >= 0.80 and line_diag_ratio <= 0.06 and skel_tiny_cc_frac <= 0.20 and skel_median_cc_area >= 14.0", "chemistry_formula_grid"),
    Step("n_cc between 90 and 280 and long_lines <= 12 and large_cc_frac >= 0.55 and skel_median_cc_area >= 10.0 and text_density <= 0.050", "sparse_formula_or_symbol_grid"),
    Step("n_cc >= 80 and long_lines >= 40 and large_cc_frac >= 0.50 and line_hv_ratio >= 0.84 and line_diag_ratio <= 0.13 and text_density >= 0.015", "orthogonal_block_flow_or_chart"),
    Step("n_cc <= 130 and long_lines >= 20 and large_cc_frac >= 0.70 and line_hv_ratio >= 0.80 and line_diag_ratio <= 0.20 and skel_median_cc_area <= 18.0 and text_density <= 0.050", "sparse_hv_block_or_network_diagram"),
    Step("n_cc <= 130 and long_lines >= 60 and large_cc_frac >= 0.80 and line_hv_ratio >= 0.50 and line_diag_ratio <= 0.35 and skel_median_cc_area <= 15.0 and text_density <= 0.050", "sparse_ui_or_device_block_diagram"),
    Step("n_cc <= 120 and long_lines >= 20 and large_cc_frac >= 0.80 and line_hv_ratio >= 0.60 and line_diag_ratio <= 0.10 and skel_median_cc_area >= 15.0 and text_density <= 0.040", "waveform_or_timing_chart"),
    Step("n_cc <= 80 and long_lines >= 30 and large_cc_frac >= 0.80 and line_hv_ratio >= 0.60 and line_diag_ratio <= 0.35 and skel_median_cc_area >= 12.0 and text_density <= 0.050", "sparse_flowchart_or_decision_tree"),
    Step("n_cc between 120 and 260 and long_lines >= 35 and large_cc_frac >= 0.45 and skel_median_cc_area >= 22.0 and line_diag_ratio between 0.14 and 0.65 and text_density <= 0.055", "mixed_flowchart_or_timing_diagram"),
    Step("n_cc >= 120 and long_lines >= 45 and large_cc_frac >= 0.64 and line_hv_ratio >= 0.60 and line_diag_ratio <= 0.26 and text_density <= 0.055", "moderate_axis_plot_or_grid"),
    Step("n_cc between 220 and 360 and long_lines >= 25 and large_cc_frac >= 0.58 and line_hv_ratio >= 0.65 and line_diag_ratio <= 0.35 and skel_median_cc_area <= 12.0 and text_density <= 0.055", "flow_schematic_component_pattern"),
    Step("n_cc >= 300 and long_lines >= 35 and large_cc_frac >= 0.60 and line_hv_ratio >= 0.55 and line_diag_ratio <= 0.30 and skel_median_cc_area <= 10.0 and text_density >= 0.045", "dense_block_network_diagram"),
    Step("n_cc between 180 and 300 and long_lines >= 50 and large_cc_frac >= 0.70 and line_diag_ratio between 0.25 and 0.45 and skel_median_cc_area >= 25.0 and text_density >= 0.055", "dense_flowchart_text_boxes"),
    Step("n_cc >= 300 and long_lines >= 50 and line_diag_ratio >= 0.55 and skel_median_cc_area <= 12.0 and text_density <= 0.060", "diagonal_lattice_network_diagram"),
    Step("text_density >= 0.055 and ((long_lines >= 120 and line_hv_ratio >= 0.75 and line_diag_ratio <= 0.08) or (n_cc >= 150 and large_cc_frac >= 0.75 and line_hv_ratio >= 0.80 and line_diag_ratio <= 0.10))", "dense_hv_chart_or_hatching"),
    Step("text_density >= 0.080 and long_lines >= 80 and line_diag_ratio <= 0.08", "dense_bar_chart_or_table"),
    Step("text_density >= 0.070 and n_cc >= 100 and long_lines >= 20", "dense_chart_hatching_or_barplot"),
    Step("n_cc >= 500 and skel_n_cc >= 500 and skel_tiny_cc_frac >= 0.55 and skel_median_cc_area <= 3.5", "label_heavy_text_or_plot"),
    Step("n_cc >= 350 and skel_n_cc >= 350 and skel_tiny_cc_frac >= 0.50 and skel_median_cc_area <= 8.0 and long_lines >= 30 and text_density <= 0.065", "legend_heavy_chart_or_plot"),
    Step("n_cc >= 450 and skel_tiny_cc_frac >= 0.25 and skel_median_cc_area <= 12.0 and text_density <= 0.080", "dense_label_or_plot_page"),
    Step("n_cc >= 100 and long_lines >= 20 and skel_tiny_cc_frac >= 0.25 and skel_median_cc_area <= 12.0 and text_density <= 0.060 and (line_diag_ratio >= 0.25 or line_hv_ratio >= 0.55)", "axis_or_legend_component_pattern"),
    Step("n_cc >= 250 and long_lines >= 120 and line_hv_ratio >= 0.75 and line_diag_ratio <= 0.16 and text_density >= 0.055", "dense_hv_axis_table_or_chart"),
    Step("n_cc between 150 and 300 and long_lines <= 12 and line_hv_ratio >= 0.80 and line_diag_ratio <= 0.05 and skel_tiny_cc_frac >= 0.35 and skel_median_cc_area <= 12.0 and text_density <= 0.035", "polar_axis_or_formula_plot"),
    Step("n_cc between 120 and 220 and long_lines >= 15 and line_hv_ratio >= 0.85 and line_diag_ratio <= 0.05 and text_density <= 0.050", "hv_timeline_table_or_axis_plot"),
    Step("n_cc between 90 and 140 and long_lines >= 30 and large_cc_frac >= 0.65 and line_hv_ratio >= 0.55 and line_diag_ratio <= 0.25 and skel_median_cc_area <= 12.0 and text_density <= 0.025", "low_density_axis_curve_plot"),
    Step("n_cc <= 90 and long_lines >= 45 and line_hv_ratio >= 0.70 and line_diag_ratio <= 0.12 and skel_tiny_cc_frac >= 0.45 and skel_median_cc_area <= 6.0 and text_density <= 0.030", "sparse_tiny_table_or_timeline"),
    Step("n_cc <= 80 and long_lines >= 50 and large_cc_frac >= 0.85 and line_diag_ratio >= 0.55 and text_density <= 0.070", "sparse_diagonal_chart_or_projection"),
    Step("n_cc >= 500 and large_cc_frac <= 0.50 and long_lines >= 30 and skel_tiny_cc_frac >= 0.35 and line_diag_ratio >= 0.45 and text_density <= 0.060", "dense_diagonal_scientific_plot"),
    Step("text_density >= 0.065 and long_lines >= 70 and large_cc_frac >= 0.78 and (line_diag_ratio >= 0.60 or line_hv_ratio >= 0.75)", "dense_axis_chart_or_hatching"),
    Step("n_cc <= 120 and long_lines >= 20 and large_cc_frac >= 0.75 and skel_median_cc_area >= 30.0 and (line_hv_ratio >= 0.55 or line_diag_ratio <= 0.30)", "sparse_axis_plot"),
    Step("n_cc >= 300 and text_density <= 0.075 and large_cc_frac <= 0.85 and skel_tiny_cc_frac >= 0.55 and skel_median_cc_area <= 6.0 and line_diag_ratio >= 0.25", "multi_panel_plot_or_legend"),
    Step("n_cc between 170 and 280 and long_lines >= 12 and large_cc_frac >= 0.60 and skel_tiny_cc_frac >= 0.30 and skel_median_cc_area <= 12.0 and line_diag_ratio >= 0.50 and text_density <= 0.055", "sparse_diagonal_plot_or_legend"),
    Step("n_cc between 100 and 230 and long_lines >= 10 and large_cc_frac >= 0.50 and skel_tiny_cc_frac >= 0.35 and skel_median_cc_area <= 20.0 and text_density <= 0.055 and (line_diag_ratio >= 0.25 or line_hv_ratio >= 0.55)", "small_axis_plot_or_legend"),
    Step("n_cc <= 100 and long_lines >= 25 and large_cc_frac >= 0.80 and line_hv_ratio >= 0.80 and skel_median_cc_area <= 20.0 and text_density <= 0.060", "sparse_hv_profile_or_plot"),
    Step("n_cc <= 100 and long_lines >= 40 and large_cc_frac >= 0.75 and line_diag_ratio >= 0.35 and skel_median_cc_area <= 25.0 and text_density <= 0.045", "sparse_curve_plot_low_components"),
    Step("text_density >= 0.065 and n_cc <= 100 and large_cc_frac >= 0.90 and long_lines >= 20", "dense_small_chart_or_symbol_page"),
    Step("n_cc <= 80 and long_lines >= 8 and line_hv_ratio >= 0.95 and line_diag_ratio <= 0.05 and skel_median_cc_area >= 15.0 and text_density <= 0.050", "sparse_hv_table_or_timeline"),
    Step("n_cc <= 120 and long_lines >= 40 and large_cc_frac >= 0.90 and skel_tiny_cc_frac >= 0.40 and skel_median_cc_area <= 5.0 and line_diag_ratio >= 0.40 and text_density <= 0.070", "single_curve_plot_high_large_frac"),
    Step("n_cc between 120 and 220 and long_lines >= 18 and large_cc_frac >= 0.55 and line_hv_ratio >= 0.80 and skel_median_cc_area <= 18.0 and text_density <= 0.045", "hv_component_table_or_diagram"),
    Step("n_cc between 140 and 300 and long_lines >= 6 and large_cc_frac <= 0.55 and skel_tiny_cc_frac >= 0.40 and skel_median_cc_area <= 10.0 and text_density <= 0.040 and (line_hv_ratio >= 0.45 or line_diag_ratio <= 0.10)", "sparse_low_large_plot_or_legend"),
    Step("n_cc between 120 and 220 and long_lines >= 8 and large_cc_frac <= 0.60 and line_hv_ratio >= 0.60 and line_diag_ratio <= 0.30 and skel_median_cc_area <= 12.0 and text_density <= 0.040", "moderate_sparse_axis_plot"),
    Step("n_cc between 240 and 360 and large_cc_frac <= 0.65 and long_lines <= 18 and skel_tiny_cc_frac >= 0.40 and skel_median_cc_area <= 12.0 and line_diag_ratio >= 0.45 and text_density <= 0.040", "sparse_scientific_diagram"),
    Step("n_cc <= 130 and long_lines >= 25 and large_cc_frac >= 0.65 and line_diag_ratio >= 0.65 and skel_median_cc_area <= 14.0 and text_density <= 0.040", "sparse_diagonal_axis_plot"),
    Step("n_cc <= 180 and long_lines >= 10 and large_cc_frac >= 0.60 and skel_median_cc_area >= 20.0 and text_density <= 0.055 and (line_hv_ratio >= 0.48 or line_diag_ratio >= 0.30)", "sparse_curve_axis_or_timing_plot"),
    Step("n_cc between 120 and 260 and long_lines >= 20 and large_cc_frac >= 0.62 and skel_tiny_cc_frac >= 0.12 and skel_median_cc_area <= 30.0 and text_density <= 0.055 and (line_hv_ratio >= 0.60 or line_diag_ratio <= 0.25)", "text_axis_or_legend_plot"),
]
CONTENT_FEATURES = ["n_cc", "long_lines", "large_cc_frac", "line_hv_ratio", "line_diag_ratio", "skel_tiny_cc_frac", "skel_median_cc_area", "text_density", "skel_n_cc"]


def with_zeros(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table with 0 for what these columns lack."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})
