"""A cross-section of the registered queries against their SQL on the smallest tables."""

import pytest

from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
NAMES = (
    "N8_label_audit", "J1_overlap_join", "N3_gaps", "W2_coalesce_adjacent", "W3_resolve_overlaps", "J2_basis_choice", "P3_capacity_allocation", "P10_projection_audit",
    "S5_S7_W1_parsed_rows", "W6_resample", "W20_moving_average", "L4_bounded_balance", "G1_components", "A2_polygon_validity", "J13_workbook_folder_pairs", "N24_duplicate_samples", "I14_resolved_images",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    text, _, ok = check(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert ok, text


def test_contract(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
