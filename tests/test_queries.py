"""Registered queries against their SQL twins. A cross-section by default; ``ALL_QUERIES=1`` runs every one."""

import os

import pytest
from check import compare, connect

from tilewright.plans import all_queries

SF = "/root/testdata/sf0.001"
CROSS_SECTION = [
    "prototype_assignment", "prototype_composition", "knn_pairs", "radius_edges", "interface_density", "log2_enrichment",
    "weighted_cell_expression", "welch_test", "concordance_index", "kaplan_meier_curves", "log_rank_test",
    "gene_symbol_cleanup", "attribute_maps", "hazard_risk", "label_attachment", "cohort_label_file", "geojson_polygons",
    "marker_bank", "rank_signature_scores", "stratified_split", "type_enriched_squares", "resumed_assignment",
    "radial_profile", "threshold_search_cindex", "cox_single_covariate", "kmeans_centres", "auc_with_interval", "patch_files",
    "mann_whitney_all_and_cohort", "interface_expression_signed_rank", "tagged_result_union", "interaction_exports",
    "tenx_directory", "top_cells_per_prototype", "largest_samples", "placed_cells", "contrasts_in_long_form",
    "matrix_market_prefilter", "gene_map_file", "log_normalised_counts", "bootstrap_stability", "spatial_deduplication",
    "training_expression_files", "sample_expression_files",
    "all_gene_prediction_files", "all_label_values", "top_genes_of_all_prototypes",
    "all_gene_set_paired_test", "elastic_net_weights", "combination_report", "chosen_two_feature_weights",
    "component_reconstruction", "single_sample_enrichment", "over_representation", "prior_alignment", "cohort_config",
]
ROWS_ONLY = {"principal_components"}
QUERIES = all_queries()


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ALL_QUERIES") else CROSS_SECTION)
def test_query_matches_sql(spark, con, name):
    message, _ = compare(spark, con, QUERIES[name], SF)
    assert message.startswith(("ok", "rows-only")), message


def test_only_the_listed_queries_lack_sql():
    assert {n for n, q in QUERIES.items() if q.sql is None} == ROWS_ONLY
