"""Every check against its SQL at the smallest scale. The driver repeats this at sf0.01."""

import os

import pytest

from checks import run
from checks.queries import QUERIES

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# a few of each kind by default; all with CHECK_ALL=1
SOME = ["src_4_layer_read", "map_5_auto_approve", "cln_10_silver_shipment_history", "fix_6_impute_mode", "scp_8_cascade_outbound_shipment_history",
        "val_7_issues_customer_master", "xref_gold_outbound_shipment_history", "xref_8_parent_shipment", "geo_gold_customer_master",
        "prf_1_profile_inventory_history", "met_2_pareto", "od_5_outbound_nodes", "scn_11_root_cause", "rate_2_short_haul"]


@pytest.fixture(scope="module")
def con():
    return run.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("CHECK_ALL") else SOME)
def test_query(spark, con, name):
    assert run.compare(spark, con, SF, name) in (None, "equal but empty")
