import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from upswell.operators import upserts
from upswell.operators.ranking import batches, global_rank
from upswell.plans import collect
from upswell.sources import tables

DAY = dt.date(2026, 7, 20)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data, ddl="id bigint, v string"):
    return spark.createDataFrame(data, ddl)


def test_last_wins(spark):
    df = frame(spark, [(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, None, 1)], "id bigint, v string, seq int")
    assert rows(upserts.last_wins(df, ["id"], F.col("seq")).drop("seq")) == [(1, "b"), (2, None)]


def test_policies_and_reruns(spark):
    base = frame(spark, [(1, "a"), (2, "b")])
    new = frame(spark, [(2, "B"), (3, "C")])
    once = upserts.update_all(base, new, ["id"])
    assert rows(once) == rows(upserts.update_all(once, new, ["id"])) == [(1, "a"), (2, "B"), (3, "C")]
    kept = upserts.insert_only(base, new, ["id"])
    assert rows(kept) == rows(upserts.insert_only(kept, new, ["id"])) == [(1, "a"), (2, "b"), (3, "C")]
    early = upserts.keep_first(base, frame(spark, [(2, "0"), (3, "z"), (3, "y")]), ["id"], "v")
    assert rows(early) == [(1, "a"), (2, "b"), (3, "y")]


def test_tags_keep_their_canon(spark):
    ddl = "id bigint, name string, category string, canon_name string, canon_confidence float, canon_status string"
    base = frame(spark, [(1, "old", "c", "Rock", 0.5, "canon_lite"), (3, "x", None, None, None, "demoted")], ddl)
    new = frame(spark, [(1, "new", None), (2, "fresh", "k")], "id bigint, name string, category string")
    for _ in range(2):
        base = upserts.upsert_tags(base, new)
    assert rows(base) == [
        (1, "new", None, "Rock", 0.5, "canon_lite"),
        (2, "fresh", "k", None, None, "pending"),
        (3, "x", None, None, None, "demoted"),
    ]
    results = frame(
        spark,
        [(1, "demoted", None, None), (2, "canon_flash", "Pop", 0.75), (3, "pending", None, None)],
        "id bigint, status string, canon_name string, confidence double",
    )
    assert [(r[0], *r[3:]) for r in rows(upserts.canon_apply(base, results))] == [
        (1, "Rock", 0.5, "demoted"), (2, "Pop", 0.75, "canon_flash"), (3, None, None, "demoted")
    ]


def test_orphans(spark):
    child, parent = frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(1, "p"), (1, "q")])
    assert rows(upserts.linked(child, parent, "id", "id")) == [(1, "a")]
    assert rows(upserts.orphans(child, parent, "id", "id")) == [(2, "b")]


def seed_pages(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"items": items, "totalCount": len(items)}))


def test_seed_twice(spark, tmp_path):
    root, pages = str(tmp_path / "db"), tmp_path / "pages"
    tables.create_tables(spark, root)
    seed_pages(
        pages, "p0.json",
        {"id": 1, "name": "a", "tags": [{"tag": {"id": 5, "name": "rock"}}], "artists": [{"artist": {"id": 8, "name": "P"}, "roles": "Mixer"}]},
        {"id": 2, "name": "b", "originalVersionId": 1, "publishDate": "2026-07-01"},
        {"id": 3, "name": "c", "originalVersionId": 99},
    )
    first = collect.seed(spark, root, str(pages))
    assert first == {
        "songs": 3, "artists": 1, "tags": 1, "song_artists": 1, "song_tags": 1, "derived_linked": 1, "derived_seen": 2,
        "fetched": 3, "total_matching": 3, "complete": True,
    }
    before = {n: rows(tables.scan(spark, root, n)) for n in ("song_tags", "song_artists", "derived_works", "tags")}
    created = rows(tables.scan(spark, root, "songs").select("id", "created_at"))
    # The same page again, and the missing original: its link is picked up, the first one keeps its time.
    seed_pages(pages, "p1.json", {"id": 99, "name": "original"}, {"id": 1, "name": "renamed"})
    assert collect.seed(spark, root, str(pages))["derived_linked"] == 2
    after = {n: rows(tables.scan(spark, root, n)) for n in before}
    assert [x for x in after["derived_works"] if x[0] == 1] == before["derived_works"]
    assert len(after["derived_works"]) == 2
    assert all(after[n] == before[n] for n in ("song_tags", "song_artists", "tags"))
    songs = {r.id: r for r in tables.scan(spark, root, "songs").collect()}
    assert songs[1].title == "renamed" and len(songs) == 4
    assert [(i, songs[i].created_at) for i, _ in created] == created


def test_daily_metrics(spark, tmp_path):
    root = str(tmp_path / "db")
    tables.create_tables(spark, root)
    songs = spark.createDataFrame(
        [(1, "a", None, None, "sm1", None, None, None), (2, "b", None, None, "sm2", None, None, None)],
        tables.TABLES["songs"],
    )
    tables.write_table(songs, root, "songs")

    def land(name, views):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "p.json").write_text(json.dumps({"data": [{"contentId": "sm1", "viewCounter": views}]}))
        return str(folder)

    for name, views, day in (("x", 100, 0), ("y", 150, 0), ("z", 200, 1)):
        counts, missing = collect.collect_daily(spark, root, land(name, views), DAY + dt.timedelta(days=day))
        assert counts == {"requested": 2, "written": 1} and [r.id for r in missing.collect()] == [2]
    stored = tables.scan(spark, root, "metrics_daily")
    assert [r[:4] for r in rows(stored.select("song_id", "metric_date", "source", "views"))] == [
        (1, DAY, "niconico", 150), (1, DAY + dt.timedelta(days=1), "niconico", 200)
    ]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_global_rank(spark, n):
    # Half of the rows share one value: the order must come from the second key.
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 11).alias("uses"))
    ranked = global_rank(df.repartition(5), F.desc("uses"), F.asc("id"))
    got = {r.id: r.rank for r in ranked.collect()}
    order = sorted(((r.id, r.uses) for r in df.collect()), key=lambda r: (-r[1], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    packed = batches(df, 64, F.desc("uses"), F.asc("id")).collect()
    assert {r.id: r.batch_no * 64 + r.pos for r in packed} == got
