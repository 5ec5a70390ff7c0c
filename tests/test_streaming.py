import datetime as dt
import json
import random

from pyspark.sql import functions as F

from upswell.operators import weekly
from upswell.schemas import ID_RANGE
from upswell.sources import tables
from upswell.streaming import jobs

DAY = dt.date(2026, 7, 20)


def test_metrics_arrive_in_two_files(spark, tmp_path):
    root, pages = str(tmp_path / "db"), tmp_path / "pages"
    pages.mkdir()
    tables.create_tables(spark, root)
    songs = spark.createDataFrame([(1, "a", None, None, "sm1", None, None, None)], tables.TABLES["songs"])
    tables.write_table(songs, root, "songs")
    for views in (100, 150, 150):
        (pages / f"{views}.json").write_text(json.dumps({"data": [{"contentId": "sm1", "viewCounter": views}]}))
        jobs.stream_metrics(spark, root, str(pages), DAY, str(tmp_path / "progress")).awaitTermination()
    stored = tables.scan(spark, root, "metrics_daily").collect()
    assert [(r.song_id, r.metric_date, r.views) for r in stored] == [(1, DAY, 150)]


def arrive(spark, folder, *rows):
    spark.createDataFrame(rows, "original_song_id bigint, derived_song_id bigint, discovered_at timestamp").coalesce(
        1
    ).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    ddl = "original_song_id bigint, derived_song_id bigint, discovered_at timestamp"
    return spark.readStream.schema(ddl).parquet(str(folder))


def test_weekly_counts(spark, tmp_path):
    src, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    at = lambda d: dt.datetime(2026, 7, 20, 1) + dt.timedelta(days=d)

    def run():
        jobs.stream_deriv_weekly(stream(spark, src), out, progress).awaitTermination()
        rows = spark.read.schema("song_id bigint, n bigint, week date").parquet(out).collect()
        return {(r.song_id, str(r.week)): r.n for r in rows}

    arrive(spark, src, (1, 10, at(0)), (1, 11, at(6)), (1, 12, at(7)), (2, 13, at(-1)))
    assert run() == {(1, "2026-07-20"): 2, (1, "2026-07-27"): 1, (2, "2026-07-13"): 1}
    arrive(spark, src, (1, 14, at(8)), (1, 15, at(5)))
    assert run() == {(1, "2026-07-20"): 3, (1, "2026-07-27"): 2, (2, "2026-07-13"): 1}
    arrive(spark, src, (1, 16, at(40)))
    run()
    # A row that is weeks late still amends its week.
    arrive(spark, src, (1, 17, at(1)), (1, 18, at(41)))
    found = run()
    assert found[(1, "2026-07-20")] == 4 and found[(1, "2026-08-24")] == 2


def test_shuffled_arrival_equals_the_batch_count(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.randrange(6) if draw.random() < 0.6 else 1, i, dt.datetime(2026, 7, 1) + dt.timedelta(hours=draw.randrange(2000))) for i in range(300)]
    src, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    for part in range(3):
        arrive(spark, src, *rows[part::3])
        jobs.stream_deriv_weekly(stream(spark, src), out, progress).awaitTermination()
    whole = spark.read.parquet(str(src))
    expected = sorted((r.song_id, r.week, r.n) for r in weekly.deriv_counts(whole).collect())
    found = spark.read.schema(jobs._COUNTS).parquet(out)
    assert sorted((r.song_id, r.week, r.n) for r in found.collect()) == expected


def test_a_batch_run_twice_adds_once(spark):
    week = dt.date(2026, 7, 20)
    stored = spark.createDataFrame([(1, 5, 0, week), (2, 7, 3, week)], jobs._COUNTS)
    fresh = spark.createDataFrame([(1, week, 2), (2, week, 4), (3, week, 1)], "song_id bigint, week date, n bigint")
    once = jobs.add_counts(stored, fresh, 3)
    assert sorted((r.song_id, r.n, r.batch) for r in once.collect()) == [(1, 7, 3), (2, 7, 3), (3, 1, 3)]
    assert sorted(map(str, jobs.add_counts(once, fresh, 3).collect())) == sorted(map(str, once.collect()))


def test_links_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    at = dt.datetime(2026, 7, 20)
    # The last repeat comes long after any watermark.
    for rows in (
        ((1, 10, at), (1, 10, at), (1, 11, at)),
        ((1, 10, at + dt.timedelta(hours=3)), (2, 10, at)),
        ((1, 10, at + dt.timedelta(days=90)), (2, 10, at - dt.timedelta(days=90))),
    ):
        arrive(spark, src, *rows)
        jobs.stream_dedupe_links(
            stream(spark, src), ["original_song_id", "derived_song_id"], "discovered_at", out, str(tmp_path / "progress")
        ).awaitTermination()
    found = spark.read.parquet(out).select("original_song_id", "derived_song_id").collect()
    assert sorted(map(tuple, found)) == [(1, 10), (1, 11), (2, 10)]
    assert spark.read.parquet(out).agg(F.max("discovered_at")).first()[0] == at


def test_links_read_their_own_ranges(spark, tmp_path):
    """A file that cannot be read, in a range that no row of the batch falls in, is not met."""
    src, out = tmp_path / "in", tmp_path / "out"
    at, far = dt.datetime(2026, 7, 20), 5 * ID_RANGE
    keys = ["original_song_id", "derived_song_id"]

    def run(*rows):
        arrive(spark, src, *rows)
        jobs.stream_dedupe_links(stream(spark, src), keys, "discovered_at", str(out), str(tmp_path / "progress")).awaitTermination()

    run((1, 10, at), (far, 11, at))
    assert sorted(p.name for p in out.glob("key_range=*")) == ["key_range=0", "key_range=5"]
    (out / "key_range=0" / "part-broken.parquet").write_bytes(b"no parquet at all")
    run((far, 11, at), (far + 1, 12, at), (far + 1, 12, at))
    found = spark.read.parquet(str(out / "key_range=5")).select(*keys).collect()
    assert sorted(map(tuple, found)) == [(far, 11), (far + 1, 12)]


def test_text_keys_are_dealt_by_hash(spark):
    rows = spark.range(500).selectExpr("concat('k', id) as k", "id as n")
    ranges = {r[0] for r in rows.select(jobs.key_range(rows.schema, "k")).collect()}
    assert len(ranges) > 50 and min(ranges) >= 0 and max(ranges) < jobs.HASH_RANGES
    assert {r[0] for r in rows.select(jobs.key_range(rows.schema, "n")).collect()} == {0}
