"""Pages from a function: all of them, once, and a missing one noticed."""

import datetime as dt
import json
import sys

import pytest
from pyspark import cloudpickle

from upswell.plans import collect
from upswell.schemas import METRIC_PAGE, SONG_PAGE
from upswell.sources import landed, paged, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SONGS = [{"id": i, "name": f"song {i}", "publishDate": "2026-07-20T00:00:00Z", "pvs": [{"service": "NicoNicoDouga", "pvId": f"sm{i}", "pvType": "Original"}]} for i in range(1, 24)]


def listing(known):
    def fetch(start, size):
        return json.dumps({"items": known[start : start + size], "totalCount": len(known)})

    return fetch


def with_a_gap(start, size):
    return None if start == 10 else listing(SONGS)(start, size)


def broken(start, size):
    return "{not json" if start == 10 else listing(SONGS)(start, size)


def readings(start, size):
    rows = [{"contentId": f"sm{i}", "viewCounter": 10 * i} for i in range(1, 24)]
    return json.dumps({"data": rows[start : start + size], "totalCount": 23})


def test_every_page_has_a_partition(spark):
    pages = paged.read_paged(spark, listing(SONGS), SONG_PAGE, size=5)
    assert pages.rdd.getNumPartitions() == 5
    items = landed.song_items(pages).orderBy("seq").select("item.id", "seq.page").collect()
    assert [(r.id, r.page) for r in items] == [(s["id"], 5 * n) for n in range(5) for s in SONGS[5 * n : 5 * n + 5]]
    found = landed.page_coverage(pages, [], size=5).first()
    assert (found.pages, found.fetched, found.total_matching, found.complete) == (5, 23, 23, True)
    cut = paged.read_paged(spark, listing(SONGS), SONG_PAGE, "cut", size=5, max_pages=2)
    found = landed.page_coverage(cut, [], size=5, max_pages=2).first()
    assert (found.pages, found.complete, found.at_limit) == (2, False, True)


def test_a_listing_without_items(spark):
    pages = paged.read_paged(spark, listing([]), SONG_PAGE, "none")
    assert landed.song_items(pages).count() == 0 and landed.page_coverage(pages, []).first().complete


@pytest.mark.parametrize("fetch, what", [(with_a_gap, "page from 10 is missing"), (broken, "MALFORMED|malformed")])
def test_a_missing_or_broken_page_fails_the_read(spark, fetch, what):
    with pytest.raises(Exception, match=what):
        landed.song_items(paged.read_paged(spark, fetch, SONG_PAGE, "faulty", size=5)).collect()


def test_collection_from_functions(spark, tmp_path):
    root = str(tmp_path / "db")
    tables.create_tables(spark, root)
    counts = collect.seed(spark, root, paged.read_paged(spark, listing(SONGS), SONG_PAGE, "songs", size=5))
    assert counts["fetched"] == 23 and counts["complete"] and tables.scan(spark, root, "songs").count() == 23
    day = dt.date(2026, 7, 20)
    counts, missing = collect.collect_daily(spark, root, paged.read_paged(spark, readings, METRIC_PAGE, "readings", size=10), day)
    assert counts == {"requested": 23, "written": 23} and missing.count() == 0
    assert tables.scan(spark, root, "metrics_daily").where("views = 10 * song_id").count() == 23


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """New items at the end of a listing arrive; nothing is read twice."""
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for known, name in ((SONGS[:7], "first"), (SONGS, "then")):
        spark.dataSource.register(paged.paged_source("grows", listing(known), size=5))
        arriving = landed.song_items(paged.parsed(spark.readStream.format("grows").load(), SONG_PAGE)).select("item.id")
        query = arriving.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [s["id"] for s in SONGS]
