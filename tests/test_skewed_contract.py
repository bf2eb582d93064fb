"""Queries on tables where one key, value or place holds a third of the rows, with nothing broadcast."""

import os

import pytest

from contract import CASES
from contract.compare import compare, duck
from tests.skewed import skewed_copy

SOURCE = "/root/testdata/sf0.001"
NAMES = [
    "null_group_sum", "null_safe_outer", "vintage_latest", "lookup_fill", "joins_basic", "member_average", "member_tags",
    "gazetteer_tags", "text_corrections", "seniority", "rank_by_value", "ranked_values", "top3_per_customer", "top_keys_detail",
    "quantiles_by_group", "quantile_bins", "class_breaks_positive", "boot_median", "boot_wmean_draws", "boot_wmean_poisson",
    "powerlaw_sums", "contains_join", "nearest_join", "within_distance_join", "smoothed_sources", "report_staff_per_year",
    "report_outfall_rollup", "report_ranked_penalties", "report_seniority_gain", "report_discharge_by_town",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="driver tables are not here")


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    d = skewed_copy(SOURCE, str(tmp_path_factory.mktemp("skewed")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield d, duck(d)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_under_skew(spark, skewed, name):
    d, con = skewed
    result, _ = compare(spark, con, d, CASES[name])
    assert result == "ok", result
