"""What the physical plans must look like to hold at scale."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from upswell.operators import canon, shares, similarity, weekly
from upswell.sources import tables

WEEK = dt.date(2024, 1, 15)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables in which one tag is on every song and one song has a third of the readings."""
    root = str(tmp_path_factory.mktemp("plans"))
    tables.create_tables(spark, root)
    days = F.expr("date_add(date '2023-12-01', cast(id % 60 as int))")
    hot = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 900).alias("song_id")
    metrics = spark.range(54_000).select(hot, days.alias("metric_date"), F.lit("s").alias("source"), F.col("id").alias("views"))
    metrics = metrics.groupBy("song_id", "metric_date", "source").agg(F.max("views").alias("views"))
    songs = spark.range(900).select("id", F.lit("t").alias("title"), F.expr("date_add(date '2023-12-01', cast(id % 60 as int))").alias("publish_date"))
    tags = spark.range(300).select("id", F.lit("n").alias("name"), F.concat(F.lit("c"), F.col("id") % 40).alias("canon_name"), F.lit("canon_lite").alias("canon_status"))
    links = spark.range(90_000).select(
        F.expr("(id div 2) % 900").alias("song_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 300).alias("tag_id")
    )
    works = spark.range(500).select((F.col("id") % 30).alias("original_song_id"), F.col("id").alias("derived_song_id"), F.lit(dt.datetime(2024, 1, 10)).alias("discovered_at"))
    for name, df in {"songs": songs, "tags": tags, "song_tags": links, "metrics_daily": metrics, "derived_works": works}.items():
        for f in tables.TABLES[name]:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        tables.write_table(df, root, name)
    return tables.scan_tables(spark, root)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_readings_are_aggregated_once(stored):
    rows = weekly.trend_rows(
        stored["metrics_daily"], stored["derived_works"], stored["song_tags"], stored["tags"], WEEK, cluster_min_songs=1
    )
    plan = final_plan(rows)
    assert plan.count("metrics_daily]") == 1 and "ReusedExchange" in plan
    assert "TakeOrderedAndProject(limit=15" in plan
    assert "ReadSchema: struct<song_id:bigint,views:bigint>" in plan


def test_no_row_is_multiplied_for_distinct_counts(stored):
    plan = final_plan(weekly.view_deltas(stored["metrics_daily"], WEEK))
    assert "Expand" not in plan and plan.count("partial_max") == 1 + 3


def test_dates_prune_partitions(stored):
    day = stored["metrics_daily"].where(F.col("metric_date") == F.lit(WEEK))
    assert "PartitionFilters: [isnotnull(metric_date" in final_plan(day.select("song_id"))
    plan = final_plan(shares.tag_week_counts(stored["songs"], stored["song_tags"], stored["tags"], WEEK))
    assert "GreaterThanOrEqual(publish_date,2024-01-08)" in plan


def test_links_are_counted_before_they_move(stored):
    plan = final_plan(canon.usage_counts(stored["tags"].withColumn("canon_status", F.lit("pending")), stored["song_tags"]))
    assert "partial_count" in plan


def exchanges(plan):
    return [line for line in plan.splitlines() if "hashpartitioning(" in line]


def test_pairs_move_links_by_song_only(stored):
    tagged = stored["song_tags"].select("song_id", F.concat(F.lit("c"), F.col("tag_id") % 40).alias("canon")).distinct()
    plan = final_plan(weekly.tag_pairs(tagged, 2))
    assert re.search("BroadcastHashJoin .*LeftSemi", plan)
    assert not [x for x in exchanges(plan) if "hashpartitioning(canon" in x and "song_id" in x]


def test_neighbours_are_limited_before_titles(spark, stored):
    emb = spark.range(50).selectExpr("id as song_id", "array(cast(id as float), 1f) as embedding")
    plan = final_plan(similarity.cosine_topk(emb, stored["songs"], 7))
    assert plan.count("TakeOrderedAndProject(limit=10") == 1 and "Sort [dist" in plan
    assert plan.index("Join") < plan.index("TakeOrderedAndProject(limit=10")


def test_no_text_is_a_join_key(spark, stored):
    rows = stored["songs"].selectExpr("id as song_id", "title", "song_type", "array('a') as artists", "array('b') as tags")
    known = spark.createDataFrame([], "song_id bigint, source_text string, model string")
    plan = similarity.select_stale(rows, known, "m")._jdf.queryExecution().sparkPlan().toString()
    assert "source_text" not in plan[plan.index("Join") :].splitlines()[0]


def test_link_batches_read_their_id_ranges(spark, stored, tmp_path):
    root = str(tmp_path / "db")
    tables.create_tables(spark, root)
    links = spark.range(4).selectExpr("id * 1000000 as song_id", "id as tag_id")
    tables.append_table(links, root, "song_tags")
    part = tables.touched(spark, root, "song_tags", links.where("tag_id = 2"))
    assert [r.tag_id for r in part.collect()] == [2] and "PartitionFilters: [isnotnull(id_range" in final_plan(part)
    with pytest.raises(Exception, match="song_tags.tag_id is NULL"):
        tables.append_table(links.withColumn("tag_id", F.lit(None).cast("long")), root, "song_tags")


def test_hot_tag_is_split(spark, stored):
    """Half of the links carry one tag; the sort-merge join must not leave them to one task."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = stored["song_tags"].repartition(8)
        plan = final_plan(weekly.tag_map(links, stored["tags"]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in plan


@pytest.mark.parametrize("week", [dt.date(2023, 12, 25), WEEK])
def test_hot_song_scores_are_right(stored, week):
    readings = [(r.song_id, r.metric_date, r.views) for r in stored["metrics_daily"].collect()]
    end = week + dt.timedelta(days=7)
    expected = {}
    for song, day, views in readings:
        e = expected.setdefault(song, [None, None, None, set()])
        for i, limit in enumerate((week - dt.timedelta(days=7), week, end)):
            if day < limit:
                e[i] = max(views, e[i] or 0)
        if day < end:
            e[3].add(day - dt.timedelta(days=day.weekday()))
    got = {r.song_id: (r.v_prev, r.v_start, r.v_end, r.weeks) for r in weekly.view_deltas(stored["metrics_daily"], week).collect()}
    assert got == {s: (*e[:3], len(e[3])) for s, e in expected.items()}
