"""The registered queries against their SQL on the smallest tables."""

import pytest

from sylvan import queries as own

from .conftest import SF
from .duck import connect, rows_of, rows_of_sql

# Every family once; the driver compares all of them.
NAMES = ["f5_not_or", "f7_not_exists", "f8_membership", "a3_integer_division", "j17_captures", "k1_first_witness", "k2_theta", "k3_multi_way", "k5_left_anti", "k7_fk_chain", "k11_mounts", "g8_join", "g12_ungroup", "g14_subcontext", "g14_theta_subcontext", "g18_pivot", "w1_global_window", "w3_lag", "s6_slice", "s10_map", "e5_round_trips", "c4_date_parts", "revenue_top_orders", "w4_null_keys", "p9_nested", "c10_number_to_duration", "q2_quantities", "k4_left_outer", "t6_default", "n5_ancestor", "n6_next_sibling", "j6_counts", "d1_json", "w7_difference", "p6_shortest", "json_props"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    assert rows_of(own.queries()[name](spark, SF)) == rows_of_sql(connect(SF), own.oracle_sql()[name])


def test_html_is_shredded(spark):
    found = own.queries()["html_titles"](spark, SF)
    assert found.columns == ["page", "title"] and found.count() > 0
