import datetime as dt
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from upswell.operators import rollups, shares, weekly

WEEK = dt.date(2026, 7, 20)
DAY = dt.timedelta(days=1)


def metrics(spark, rows):
    return spark.createDataFrame(rows, "song_id bigint, metric_date date, source string, views bigint")


def derived(spark, rows):
    return spark.createDataFrame(rows, "original_song_id bigint, derived_song_id bigint, discovered_at timestamp")


def tagged(spark, rows):
    return spark.createDataFrame(rows, "song_id bigint, canon string")


def links(spark, rows):
    """The same as stored tables: links to tags, and tags with a confirmed canon."""
    ids = {t: i for i, t in enumerate(sorted({t for _, t in rows}))}
    tags = spark.createDataFrame(
        [(i, t, "canon_lite") for t, i in ids.items()], "id bigint, canon_name string, canon_status string"
    )
    return spark.createDataFrame([(s, ids[t]) for s, t in rows], "song_id bigint, tag_id bigint"), tags


def test_velocity_and_coldstart(spark):
    saturday = WEEK + 5 * DAY
    rows = [(1, saturday - 14 * DAY, "s", 1_000), (1, saturday - 7 * DAY, "s", 11_000), (1, saturday, "s", 41_000)]
    rows.append((2, saturday, "s", 300))
    out = weekly.trend_rows(metrics(spark, rows), derived(spark, []), *links(spark, []), WEEK)
    found = {r.song_id: (r.view_velocity, r.deriv_velocity, r.is_coldstart) for r in out.collect()}
    assert found == {1: (3.0, None, False), 2: (None, None, True)}


def test_flat_baseline_has_no_velocity(spark):
    views = spark.createDataFrame(
        [(1, 500, 500, 900, 3), (2, None, 500, 900, 3)],
        "song_id bigint, v_prev bigint, v_start bigint, v_end bigint, weeks bigint",
    )
    none = spark.createDataFrame([], "song_id bigint, n_this bigint, n_prev bigint")
    assert [(r.view_velocity, r.is_coldstart) for r in weekly.score(views, none).collect()] == [(None, False)] * 2


def test_boundaries_sources_and_future(spark):
    rows = [
        (1, WEEK - 8 * DAY, "a", 5), (1, WEEK - 7 * DAY, "b", 9), (1, WEEK - DAY, "a", 7),
        (1, WEEK, "a", None), (1, WEEK + 6 * DAY, "b", 20), (1, WEEK + 7 * DAY, "a", 99), (2, WEEK + 9 * DAY, "a", 1),
    ]
    found = {r.song_id: tuple(r)[1:] for r in weekly.view_deltas(metrics(spark, rows), WEEK).collect()}
    assert found == {1: (5, 9, 20, 3), 2: (None, None, None, 0)}
    only_a = {r.song_id: tuple(r)[1:] for r in weekly.view_deltas(metrics(spark, rows), WEEK, "a").collect()}
    assert only_a[1] == (5, 7, 7, 3)


def test_derivative_mean_of_four_weeks(spark):
    at = lambda days: dt.datetime(2026, 7, 20, 12) + dt.timedelta(days=days)
    rows, n = [], 0
    for week in range(1, 5):
        for _ in range(2):
            n += 1
            rows.append((1, n, at(-7 * week)))
    rows += [(1, 100 + i, at(1)) for i in range(8)] + [(1, 999, at(-35)), (1, 998, at(7))]
    base = weekly.deriv_base(derived(spark, rows), WEEK)
    assert [tuple(r) for r in base.collect()] == [(1, 8, 8)]
    counts = {r.week: r.n for r in weekly.deriv_counts(derived(spark, rows)).collect()}
    assert counts[WEEK] == 8 and counts[WEEK - 7 * DAY] == 2 and len(counts) == 7


def test_clusters(spark):
    top = spark.createDataFrame([(i, i) for i in range(1, 8)], "song_id bigint, rank int")
    tags = tagged(spark, [(i, t) for i in range(1, 7) for t in ("a", "b")] + [(7, "a"), (7, "c")])
    found = weekly.detect_clusters(top, tags).collect()
    assert [(r.tags, r.songs, r.cluster_id) for r in found] == [(["a", "b"], [1, 2, 3, 4, 5, 6], 1)]
    of = {r.song_id: r.cluster_id for r in weekly.cluster_of(weekly.detect_clusters(top, tags)).collect()}
    assert of == {i: 1 for i in range(1, 7)}


@pytest.mark.parametrize("size", [1, 2, 3])
def test_clusters_against_brute_force(spark, size):
    import random

    rng = random.Random(5)
    carried = {song: sorted(rng.sample("abcdefg", rng.randint(0, 6))) for song in range(20, 32)}
    ranked = list(carried)
    first_seen: dict[tuple, list] = {}
    for song in ranked:
        for combo in combinations(carried[song], size):
            first_seen.setdefault(combo, []).append(song)
    expected = [(list(c), s) for c, s in first_seen.items() if len(s) >= 3]
    top = spark.createDataFrame([(s, i + 1) for i, s in enumerate(ranked)], "song_id bigint, rank int")
    tags = tagged(spark, [(s, t) for s, ts in carried.items() for t in ts])
    found = weekly.detect_clusters(top, tags, 3, size).orderBy("cluster_id").collect()
    assert [(r.tags, r.songs) for r in found] == expected
    assert [r.cluster_id for r in found] == list(range(1, len(expected) + 1))


def test_pairs_against_brute_force(spark):
    tags = tagged(spark, [(s, t) for s in range(6) for t in "abcd" if (s + ord(t)) % 3])
    found = {(r.tag_a, r.tag_b): r.songs for r in weekly.tag_pairs(tags, 2).collect()}
    by_song: dict = {}
    for r in tags.collect():
        by_song.setdefault(r.song_id, set()).add(r.canon)
    expected: dict = {}
    for ts in by_song.values():
        for pair in combinations(sorted(ts), 2):
            expected[pair] = expected.get(pair, 0) + 1
    assert found == {p: n for p, n in expected.items() if n >= 2}


def test_range_equals_single_weeks(spark):
    import random

    rng = random.Random(11)
    rows, found, tags = [], [], []
    for song in range(1, 30):
        views = 0
        for day in range(0, 42):
            if rng.random() < 0.35:
                views += rng.randint(0, 50)
                rows.append((song, WEEK + day * DAY, rng.choice("ab"), views))
        found += [
            (song, 1000 * song + i, dt.datetime(2026, 7, 20) + dt.timedelta(hours=rng.randint(0, 42 * 24)))
            for i in range(rng.randint(0, 9))
        ]
        tags += [(song, t) for t in rng.sample("abcde", 3)]
    args = metrics(spark, rows), derived(spark, found), *links(spark, tags)
    many = weekly.trend_range(*args, WEEK, WEEK + 35 * DAY, top=10, cluster_min_songs=3)
    many = {(r.week, r.song_id): tuple(r)[2:] for r in many.collect()}
    for i in range(6):
        week = WEEK + 7 * i * DAY
        single = weekly.trend_rows(*args, week, top=10, cluster_min_songs=3).collect()
        assert {(r.week, r.song_id): (r.view_velocity, r.deriv_velocity, r.is_coldstart, r.cluster_id) for r in single} == {
            k: v for k, v in many.items() if k[0] == week
        }
    assert any(v[3] for v in many.values())


def test_summary(spark):
    rows = spark.createDataFrame(
        [(1, WEEK, False, 1), (2, WEEK, False, None), (3, WEEK, True, None)],
        "song_id bigint, week date, is_coldstart boolean, cluster_id int",
    )
    assert tuple(weekly.trend_summary(rows).first()) == (WEEK, 2, 1, 1)


def test_fetch_sanity(spark):
    songs = spark.createDataFrame([(1,)], "id bigint")
    some = metrics(spark, [(1, WEEK, "a", 1), (1, WEEK, "b", 1), (1, WEEK + DAY, "a", 2), (1, WEEK + 7 * DAY, "a", 3)])
    assert tuple(rollups.fetch_sanity(songs, some, WEEK).first()) == (1, 3, 2, None)
    assert rollups.fetch_sanity(songs, metrics(spark, []), WEEK).first().halted == "no_metrics_this_week"
    assert rollups.fetch_sanity(songs.limit(0), some, WEEK).first().halted == "no_songs"


def test_tag_deltas(spark):
    songs = spark.createDataFrame(
        [(1, WEEK), (2, WEEK + DAY), (3, WEEK - DAY), (4, WEEK - 2 * DAY), (5, None)], "id bigint, publish_date date"
    )
    tags = spark.createDataFrame(
        [(10, "r", "Rock", "canon_lite"), (11, "r2", "Rock", "canon_flash"), (12, "p", "Pop", "canon_lite"), (13, "x", None, "pending")],
        "id bigint, name string, canon_name string, canon_status string",
    )
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 13), (3, 10), (3, 12), (5, 12)], "song_id bigint, tag_id bigint")
    found = [tuple(r) for r in shares.tag_deltas(songs, links, tags, WEEK).collect()]
    assert found == [("Rock", 50.0, 0.0)]  # one of two songs in both weeks; Pop only before
    empty_before = shares.tag_deltas(songs, links, tags, WEEK - 7 * DAY).collect()
    assert [tuple(r) for r in empty_before] == [("Pop", 50.0, 50.0), ("Rock", 50.0, 50.0)]
