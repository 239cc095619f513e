"""A query of each kind against its SQL; the whole catalog is compared at a larger size by the driver."""

import pytest

from sluice import catalog
from tests import oracle

SOME = [
    "e1_threshold_alarms", "e3_drift_alarms", "e4_sustained_alarms", "e6_alarm_events", "e7_window_coverage", "e10_correlated", "d5_event_metrics", "d36_strictness", "d16_schema_stability", "d20_kappa", "d24_merge_values", "d26_pivot",
    "b3_id_column", "b4_noise_columns", "h13_number_agreement", "h20_heading", "l6_medoid", "e13_runner_up", "k1_node_upsert", "k6_corroborated_pairs", "c22_similar_names", "n1_blocks", "a14_transcript", "m8_padded_numbers", "l2_assignment", "l4_audit_rows", "e18_weight_sweep", "m4_rotated_numbers", "m7_word_salad", "f1_sort",
]


@pytest.mark.skipif(oracle.MISSING, reason="no test data here")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    assert oracle.differ(spark, catalog.QUERIES, catalog.ORACLES, name) == ([], [], 0)
