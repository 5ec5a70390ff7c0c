"""Collection runs over landed documents: the catalogue and the daily readings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.fixed_values import METRIC_SOURCE
from upswell.operators import catalogue, upserts
from upswell.schemas import METRIC_PAGE, SONG_PAGE
from upswell.session import materialize, stages
from upswell.sources import landed, tables

ENTITIES = ("songs", "artists", "tags")
LINKS = ("song_artists", "song_tags", "derived_works")


def seed(spark: SparkSession, root: str, pages: str | DataFrame, whole_files: bool = False) -> dict[str, int]:
    """Merges song pages, landed in a folder or read by ``paged``, into the catalogue tables; returns the counts.

    Entities and links are read within the id ranges of the batch only, and of links the
    new ones are appended. Entities are written first: a run that fails in between is
    completed by running it again. The counts say what the pages announced, too:
    ``complete`` is false if pages of the run are missing.
    """
    with stages(spark):
        return _seed(spark, root, pages, whole_files)


def _seed(spark: SparkSession, root: str, pages: str | DataFrame, whole_files: bool) -> dict[str, int]:
    if isinstance(pages, DataFrame):
        landed_pages = materialize(pages)  # a page is asked for once
    else:
        landed_pages = landed.read_pages(spark, pages, SONG_PAGE, whole_files)
    coverage = landed.page_coverage(landed_pages, []).first().asDict()
    bundled = materialize(catalogue.bundles(landed.song_items(landed_pages)))
    frames = {
        name: materialize(frame)
        for name, frame in catalogue.catalogue_frames(bundled, F.col("seq")).items()
    }
    run_at = F.lit(dt.datetime.now(dt.timezone.utc))
    part = {name: tables.touched(spark, root, name, frames[name]) for name in ENTITIES}
    for name, frame in catalogue.merge_entities(part, frames, run_at).items():
        tables.write_table(frame, root, name)
    songs = tables.scan(spark, root, "songs")
    stored = {"songs": songs} | {n: tables.touched(spark, root, n, frames[n]) for n in LINKS}
    for name, frame in catalogue.new_links(stored, frames, run_at).items():
        tables.append_table(frame, root, name)
    counts = catalogue.ingest_summary(frames, songs).first().asDict()
    return counts | {c: coverage[c] for c in ("fetched", "total_matching", "complete")}


def collect_daily(
    spark: SparkSession, root: str, pages: str | DataFrame, metric_date: dt.date, whole_files: bool = False
) -> tuple[dict[str, int], DataFrame]:
    """Merges metric pages, landed or read by ``paged``, into one day; returns counts and the missing songs.

    Only the day's partition is read and rewritten.
    """
    targets = catalogue.metric_targets(tables.scan(spark, root, "songs"))
    if not isinstance(pages, DataFrame):
        pages = landed.read_pages(spark, pages, METRIC_PAGE, whole_files)
    readings = materialize(landed.metric_readings(pages))
    fresh = materialize(
        catalogue.metric_rows(targets, readings, F.lit(metric_date), METRIC_SOURCE)
    )
    upsert_day(spark, root, fresh)
    missing = catalogue.missing_targets(targets, readings)
    return {"requested": targets.count(), "written": fresh.count()}, missing


def upsert_day(spark: SparkSession, root: str, fresh: DataFrame) -> None:
    """Merges readings into the days they belong to; other days are not touched."""
    stored = tables.touched(spark, root, "metrics_daily", fresh)
    merged = upserts.update_all(
        stored.select(*fresh.columns), fresh, ["song_id", "metric_date", "source"]
    )
    tables.write_table(merged, root, "metrics_daily")
