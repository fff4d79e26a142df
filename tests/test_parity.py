import os

import pytest

from latticeworks import catalogue

from .conftest import DATA
from .parity import compare, connect

#: Of each kind some; LATTICEWORKS_ALL=1 runs every query that has SQL.
SOME = """heldout_basin_rate_wilson projection_summary unknown_community_frontier threshold_sweep standard_scaled mutual_knn_edges connected_component_sizes triangle_clustering temporal_replay_events
temporal_replay_decades community_growth bridge_rates stepping_stones first_reports spearman_first_report strict_polymorph ks_two_sample matched_strata_rates last_wins_lookup accessibility_scores accessibility_grid
k_core k_core_of_neighbours read_communities_coerced read_entry_index read_documents read_document_drops read_shards read_zip_members read_sheet written_records step_change_survey functional_rollup degree_quartiles forward_fill permutation_band_fixed formula_parse composition_class anonymized_formula family_enrichment auto_labels tolerant_parsing stream_window_rate stream_births""".split()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()) if os.environ.get("LATTICEWORKS_ALL") else SOME)
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], DATA)


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["community", "n", "k", "rate", "low", "high"]
    assert out.count() > 0
