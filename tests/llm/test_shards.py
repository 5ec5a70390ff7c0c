"""The global shuffle: one order for one set of rows, and each text moved once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from upswell.llm import sharding


def order_of(df, *columns, **how):
    found = sharding.shuffled_shards(df, **how).orderBy("shard", "slot")
    return [tuple(r) for r in found.select(*columns).collect()]


def test_order_depends_on_rows_only(spark):
    """A third of all rows on one doc_id, half of those equal in every column."""
    hot = spark.range(2 * sharding.HOT_ROWS + 300).selectExpr(
        "7L as doc_id", "if(id % 2 = 0, 'the same text', concat('text ', id)) as text", "array(id % 2) as extra"
    )
    rest = spark.range(1000, 6000).selectExpr("id as doc_id", "concat('own ', id) as text", "array(id) as extra")
    both = hot.unionByName(rest)
    how = {"bucket_bytes": 20_000, "shards": 5}
    first = order_of(both.repartition(3), "doc_id", "text", "extra", **how)
    assert len(first) == 2300 + 5000 and len({t for _, t, _ in first}) == 5000 + 1150 + 1
    assert sum(t == "the same text" for _, t, _ in first) == 1150
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert order_of(both.repartition(11, "text"), "doc_id", "text", "extra", **how) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert order_of(both, "doc_id", "text", "extra", seed=1, **how) != first


def test_hot_equal_rows_are_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    same = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "'one text' as text")
    found = sharding.shuffled_shards(same, bucket_bytes=2000).select("*", F.spark_partition_id().alias("at"))
    sizes = [r["count"] for r in found.groupBy("at").count().collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 20 and max(sizes) < 3 * 3000 / len(sizes)


def test_shuffle_against_a_plain_one(spark):
    """Every bucket's order is that of a Fisher-Yates shuffle of its sorted rows."""
    rows = [(i, f"text {i % 17}") for i in range(500)]
    found = sharding.shuffled_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), seed=3, least_buckets=4, shards=6)
    got = found.select("*", F.spark_partition_id().alias("at"), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)).alias("bucket")).collect()
    assert all(r.at == r.bucket for r in got)
    places, start = {}, 0
    for bucket in range(4):
        mine = sorted((r.doc_id, r.text) for r in got if r.bucket == bucket)
        order = np.arange(len(mine))
        np.random.default_rng([3, bucket]).shuffle(order)
        places |= {mine[k][0]: start + n for n, k in enumerate(order)}
        start += len(mine)
    counts = [84, 84, 83, 83, 83, 83]
    for r in got:
        assert sum(counts[: r.shard]) + r.slot == places[r.doc_id]


def test_text_moves_once(spark):
    """One exchange above the scan of the text; the rest works on keys."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sharding.shuffled_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("text", ["", "x" * 400_000])
def test_one_row(spark, text):
    one = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert order_of(one, "doc_id", "text", bucket_bytes=1000) == [(1, text)]
