import datetime as dt
import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from upswell.operators import evidence
from upswell.plans import weekly_run
from upswell.session import shared_dir
from upswell.sources import report_files, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEEK = dt.date(2026, 7, 20)
DAY = dt.timedelta(days=1)


@pytest.fixture
def root(spark, tmp_path):
    """Seven songs, six of them accelerating with the same two tags, one new."""
    root = str(tmp_path / "db")
    tables.create_tables(spark, root)
    songs = [(i, f"song-{i}", WEEK - 20 * DAY, "Original") for i in range(1, 7)] + [(7, "fresh", WEEK, None), (8, "quiet", WEEK - 3 * DAY, None)]
    metrics = [(i, WEEK + (5 - 7 * w) * DAY, "s", v) for i in range(1, 7) for w, v in ((2, 100), (1, 200), (0, 300 + 100 * i))]
    metrics.append((7, WEEK + DAY, "s", 5))
    tags = [(1, "r", "c", "Rock", 0.5, "canon_lite"), (2, "p", "c", "Pop", 0.5, "canon_flash"), (3, "x", "c", None, None, "pending")]
    made = {
        "songs": (songs, "id bigint, title string, publish_date date, song_type string"),
        "metrics_daily": (metrics, "song_id bigint, metric_date date, source string, views bigint"),
        "tags": (tags, "id bigint, name string, category string, canon_name string, canon_confidence float, canon_status string"),
        "song_tags": ([(s, t) for s in range(1, 8) for t in (1, 2)] + [(7, 3)], "song_id bigint, tag_id bigint"),
        "derived_works": ([(1, 50, dt.datetime(2026, 7, 21))], "original_song_id bigint, derived_song_id bigint, discovered_at timestamp"),
    }
    for name, (rows, ddl) in made.items():
        df = spark.createDataFrame(rows, ddl)
        for f in tables.TABLES[name]:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        tables.write_table(df, root, name)
    return root


def upper(model, payload, vocab):
    items = [{"id": i["id"], "canonical": "Rock", "confidence": 0.9} for i in json.loads(payload)]
    return json.dumps({"items": items})


def test_run_twice(spark, root, tmp_path):
    out = str(tmp_path / "published")
    seen = []

    def narrate(text):
        seen.append(json.loads(text))
        return "narrative"

    state = weekly_run.run_weekly(spark, root, WEEK, out, narrate, upper)
    assert state["fetch"] == {"songs": 8, "week_metrics": 7, "week_days": 2} and state["halted"] is None
    assert state["canon"]["canon_lite"] == 1 and state["canon"]["total"] == 1
    assert state["trend"] == {"scored": 6, "coldstart": 1, "clustered": 6}
    assert state["report"] == {"week": "2026-07-20", "chars": 9, "top_songs": 6, "tag_deltas": 2}
    ev = seen[0]
    assert ev["week"] == "2026-07-20"
    assert [s["song_id"] for s in ev["top_songs"]] == [6, 5, 4, 3, 2, 1]
    assert ev["top_songs"][0] == {"song_id": 6, "title": "song-6", "view_velocity": 7.0, "deriv_velocity": None, "cluster_id": 1}
    assert ev["clusters"] == [{"cluster_id": 1, "titles": [f"song-{i}" for i in (6, 5, 4, 3, 2, 1)]}]
    assert ev["watchlist"] == [{"song_id": 7, "title": "fresh"}]
    assert ev["tag_deltas"][0] == {"canon": "Pop", "share_pct": 100.0, "delta_pp": 100.0}
    assert len(state["published"]) == 2
    latest = json.loads(Path(state["published"][1]).read_text())
    assert sorted(p.name for p in Path(out).iterdir() if not p.name.startswith(".")) == ["latest.json", "report-2026-07-20.json"]
    assert latest["narrative"] == "narrative" and latest["evidence"] == ev and latest["model"] == "gw-flash"
    assert latest["generated_at"].endswith("+00:00")
    scores = tables.scan(spark, root, "trend_scores").drop("computed_at")
    first = sorted(map(tuple, scores.collect()), key=repr)
    again = weekly_run.run_weekly(spark, root, WEEK, out, narrate, upper)
    assert again["canon"]["total"] == 0 and again["trend"] == state["trend"]
    scores = tables.scan(spark, root, "trend_scores").drop("computed_at")
    assert sorted(map(tuple, scores.collect()), key=repr) == first
    assert tables.scan(spark, root, "weekly_reports").count() == 1
    weekly_run.backfill(spark, root, WEEK - 7 * DAY, WEEK)
    scores = tables.scan(spark, root, "trend_scores").drop("computed_at")
    assert sorted(map(tuple, scores.where(F.col("week") == WEEK).collect()), key=repr) == first
    assert scores.count() == 14


def unsure(model, payload, vocab):
    items = [{"id": i["id"], "canonical": "Rock", "confidence": 0.9 if model == "gw-flash" else 0.1} for i in json.loads(payload)]
    return json.dumps({"items": items})


def test_limits_are_the_callers(spark, root, tmp_path):
    more = spark.range(100, 700).selectExpr(
        "id", "concat('t', id) as name", "'c' as category", "cast(null as string) as canon_name",
        "cast(null as float) as canon_confidence", "'pending' as canon_status",
    )
    tables.append_table(more, root, "tags")
    out = str(tmp_path / "published")
    state = weekly_run.run_weekly(
        spark, root, WEEK, out, str, unsure, limit=None, cap=1000, batches_per_round=100, top=3
    )
    assert state["canon"]["total"] == 601 and state["canon"]["canon_flash"] == 601
    assert tables.scan(spark, root, "tags").where("canon_status = 'pending'").count() == 0
    assert tables.scan(spark, root, "escalation_log").count() == 601
    assert state["report"]["top_songs"] == 3
    assert not [p for p in Path(shared_dir(spark)).glob("upswell-run-*")]


def test_halts_and_defers(spark, root, tmp_path):
    out = str(tmp_path / "published")
    quiet = weekly_run.run_weekly(spark, root, WEEK + 70 * DAY, out, str)
    assert quiet["halted"] == "no_metrics_this_week" and "trend" not in quiet
    deferred = weekly_run.run_weekly(spark, root, WEEK, out, lambda text: None)
    assert deferred["report"] is None and "published" not in deferred
    assert tables.scan(spark, root, "weekly_reports").count() == 0
    reports = tables.scan(spark, root, "weekly_reports")
    assert report_files.write_report_json(reports, WEEK, out) == []


def test_watchlist_order(spark):
    scores = spark.createDataFrame([(i, WEEK, None, True) for i in range(1, 5)], "song_id bigint, week date, view_velocity double, is_coldstart boolean")
    songs = spark.createDataFrame(
        [(1, "a", WEEK), (2, "b", None), (3, "c", WEEK + DAY), (4, "d", WEEK)], "id bigint, title string, publish_date date"
    )
    assert [r.song_id for r in evidence.watchlist(scores, songs, WEEK).orderBy("rank").collect()] == [2, 3, 1, 4]


def test_latest(spark):
    rows = [(WEEK, "a", "{}", "m", dt.datetime(2026, 7, 21)), (WEEK + 7 * DAY, "b", "{}", "m", dt.datetime(2026, 7, 28))]
    latest = report_files.latest_payload(spark.createDataFrame(rows, tables.TABLES["weekly_reports"])).first()
    assert latest.week == WEEK + 7 * DAY and json.loads(latest.payload)["narrative"] == "b"


def test_a_run_that_dies_before_the_tags_logs_once(spark, root, tmp_path, monkeypatch):
    """The log is written first; the repeated run asks again, and its rows replace the first ones."""
    out, write = str(tmp_path / "published"), tables.write_table

    def dies(df, where, table):
        if table == "tags":
            raise OSError("no space left")
        write(df, where, table)

    monkeypatch.setattr(tables, "write_table", dies)
    with pytest.raises(OSError):
        weekly_run.run_weekly(spark, root, WEEK, out, str, unsure)
    monkeypatch.setattr(tables, "write_table", write)
    assert tables.scan(spark, root, "escalation_log").count() == 1
    state = weekly_run.run_weekly(spark, root, WEEK, out, str, unsure, batches_per_round=None)
    assert state["canon"]["canon_flash"] == 1
    log = tables.scan(spark, root, "escalation_log").collect()
    assert [(r.run, r.id, r.status) for r in log] == [(str(WEEK), 3, "canon_flash")]
    assert not [p for p in Path(shared_dir(spark)).glob("upswell-run-*")]
