"""Kept weekly peaks against full recomputation, and what a weekly run reads."""

import datetime as dt
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from upswell.operators import weekly
from upswell.plans import collect, kept_weeks, weekly_run
from upswell.session import materialize, stages
from upswell.sources import tables

MONDAY = dt.date(2026, 3, 2)
DAY = dt.timedelta(days=1)
ROW = "song_id bigint, metric_date date, source string, views bigint"


def store(spark, root, rows):
    fresh = spark.createDataFrame(rows, ROW)
    for f in tables.TABLES["metrics_daily"]:
        if f.name not in fresh.columns:
            fresh = fresh.withColumn(f.name, F.lit(None).cast(f.dataType))
    collect.upsert_day(spark, root, fresh)


@pytest.fixture
def root(spark, tmp_path):
    tables.create_tables(spark, str(tmp_path / "db"))
    return str(tmp_path / "db")


def deltas(frame):
    return sorted((r.song_id, r.v_prev, r.v_start, r.v_end, r.weeks) for r in frame.collect())


def test_random_late_days(spark, root):
    """Days arrive in any order, some are corrected, downwards too: as computed anew each time."""
    draw = random.Random(5)
    days = [MONDAY + i * DAY for i in range(42)]
    draw.shuffle(days)
    for part in (days[:20], days[20:30], days[30:], draw.sample(days, 3)):
        rows = [
            (s, d, src, None if draw.random() < 0.1 else draw.randrange(1000))
            for d in part for s in range(12) for src in "ab" if draw.random() < 0.3 and (d - MONDAY).days >= 3 * s - 9
        ]
        store(spark, root, rows)
        kept_weeks.refresh(spark, root)
        metrics, peaks = (tables.scan(spark, root, t) for t in ("metrics_daily", "weekly_peaks"))
        kept = weekly.kept_deltas(peaks, MONDAY - 7 * DAY, MONDAY + 42 * DAY).cache()
        for week in range(-1, 7):
            start = MONDAY + 7 * week * DAY
            assert deltas(kept.where(F.col("week") == start)) == deltas(weekly.view_deltas(metrics, start)), (start, part)
    assert kept_weeks.refresh(spark, root) == []


def test_scores_of_a_range(spark, root):
    draw = random.Random(6)
    store(spark, root, [(s, MONDAY + i * DAY, "s", 100 * i + draw.randrange(300)) for s in range(8) for i in range(0, 35, 2)])
    stored = tables.scan_tables(spark, root)
    first, last = MONDAY + 7 * DAY, MONDAY + 28 * DAY
    weekly_run.backfill(spark, root, first, last)
    found = tables.scan(spark, root, "trend_scores").select("song_id", "week", F.round("view_velocity", 4).alias("v"), "is_coldstart")
    full = weekly.trend_range(*[stored[t] for t in ("metrics_daily", "derived_works", "song_tags", "tags")], first, last)
    full = full.select("song_id", "week", F.round(F.col("view_velocity").cast("float"), 4).alias("v"), "is_coldstart")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)


def test_a_week_reads_its_own_days(spark, root, monkeypatch):
    """Of the daily readings a run reads the days that changed, and no history for the scores."""
    store(spark, root, [(1, MONDAY + i * DAY, "s", i) for i in range(28)])
    assert len(kept_weeks.refresh(spark, root)) == 4
    late = MONDAY + 15 * DAY
    store(spark, root, [(1, late, "s", 5000)])
    plans = []
    own = weekly.own_peaks

    def watched(metrics):
        plans.append(metrics._jdf.queryExecution().executedPlan().toString())
        return own(metrics)

    monkeypatch.setattr(weekly, "own_peaks", watched)
    assert kept_weeks.refresh(spark, root) == [MONDAY + 14 * DAY]
    days = {str(MONDAY + i * DAY) for i in range(14, 21)}
    filters = plans[0].split("PartitionFilters: ")[1].split("]")[0]
    assert "metric_date" in filters and set(re.findall(r"\d{4}-\d\d-\d\d", filters)) == days
    kept = weekly.kept_deltas(tables.scan(spark, root, "weekly_peaks"), MONDAY + 21 * DAY, MONDAY + 21 * DAY)
    assert "metrics_daily" not in kept._jdf.queryExecution().executedPlan().toString()
    assert deltas(kept.drop("week")) == [(1, 13, 5000, 5000, 4)]


def test_weeks_without_readings(spark, root):
    """A gap, and weeks after the newest."""
    store(spark, root, [(1, MONDAY, "s", 10)])
    kept_weeks.refresh(spark, root)
    store(spark, root, [(2, MONDAY + 21 * DAY, "s", 7)])
    kept_weeks.refresh(spark, root)
    metrics, peaks = (tables.scan(spark, root, t) for t in ("metrics_daily", "weekly_peaks"))
    gap = peaks.where((F.col("song_id") == 1) & (F.col("week") == MONDAY + 14 * DAY)).first()
    assert (gap.seen, gap.peak, gap.best, gap.weeks) == (False, None, 10, 1)
    for week in range(-1, 9):
        start = MONDAY + 7 * week * DAY
        assert deltas(weekly.kept_deltas(peaks, start, start).drop("week")) == deltas(weekly.view_deltas(metrics, start))


def test_empty(spark, root):
    assert kept_weeks.refresh(spark, root) == []
    assert weekly.kept_deltas(tables.scan(spark, root, "weekly_peaks"), MONDAY, MONDAY).collect() == []


def test_runs_in_two_threads_keep_their_files(spark):
    """A step of another thread lies outside a run's folder and outlives the run."""
    made, opened, done = {}, threading.Event(), threading.Event()

    def other():
        opened.wait(60)
        made["frame"] = materialize(spark.range(7))
        with stages(spark) as folder:
            made["own"] = folder
            made["inside"] = materialize(spark.range(3)).inputFiles()
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with stages(spark) as mine:
        opened.set()
        done.wait(120)
        assert materialize(spark.range(2)).inputFiles()[0].find(mine) > 0
    thread.join()
    assert made["frame"].count() == 7 and made["own"] != mine
    assert all(made["own"] in f for f in made["inside"])
