import __spark_entry__ as entry
import check
import pytest

SF = "/root/testdata/sf0.01"
QUICK = [
    "a1_view_deltas", "a4_tag_week_counts", "j1_parse_song", "k12_pair_self_join", "w2_detect_clusters", "r1_trend_rows",
    "r4_incremental_range", "t8_final_status", "u3_update_some", "v2_cosine_topk_all", "w9_run_cap",
]


def test_every_query_has_its_sql():
    from registry.base import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    problem = check.compare(spark, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert problem == ""
