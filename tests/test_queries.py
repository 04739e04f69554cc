import os

import pytest

from tests import oracle
from wardstone.plans.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")

#: One of each kind here; the driver holds all against DuckDB.
CHECKED = [
    "detect_vendor", "detect_precedence", "fgt_tokenize", "ipv4_shape", "eve_rejects", "eve_time_forms", "linux_time_forms", "validate_rules",
    "asa_endpoints", "fgt_traffic_endpoints", "linux_fields", "eve_decode", "fgt_unmapped_top20", "to_cef", "to_leef", "event_json", "normalize_all",
    "route_stats", "dedup_first_wins", "retention_latest_n", "events_by_source", "ip_features", "ip_outliers", "asa_sessions", "synth_cisco_asa", "panos_cef", "stream_normalize",
]


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, name):
    oracle.same(spark, QUERIES[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
