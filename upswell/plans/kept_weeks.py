"""Weekly peaks kept beside the daily readings, changed only where days have changed."""

from __future__ import annotations

import datetime as dt
import hashlib
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from upswell.operators import weekly
from upswell.session import materialize
from upswell.sources import tables

WEEK = dt.timedelta(days=7)


def _files_by_week(spark: SparkSession, root: str) -> dict[dt.date, str]:
    """A digest over the names of the files of every week's days: a listing, nothing is read.

    A write replaces the files of its days, and no two files have one name.
    """
    names: dict[dt.date, list[str]] = {}
    for path in tables.scan(spark, root, "metrics_daily").inputFiles():
        folder, name = unquote(path).rsplit("/", 2)[-2:]
        day = dt.date.fromisoformat(folder.removeprefix("metric_date="))
        names.setdefault(day - dt.timedelta(days=day.weekday()), []).append(f"{folder}/{name}")
    return {week: hashlib.sha256("\n".join(sorted(each)).encode()).hexdigest() for week, each in names.items()}


def refresh(spark: SparkSession, root: str) -> list[dt.date]:
    """Brings ``weekly_peaks`` up to date with ``metrics_daily``; returns the weeks whose days had changed.

    A week's days are read again only if their files are not those that were folded last,
    so a late or corrected reading costs its own week's days and the stored rows of the
    weeks since, never the history. Peaks are written before the digests of their files: a
    run that dies in between folds the same weeks again.

    Readings are upserted, never removed: a week whose readings were deleted by hand while
    no song had any before is not emptied.
    """
    now = _files_by_week(spark, root)
    folded = {r.week: r.files for r in tables.scan(spark, root, "folded_weeks").collect()}
    changed = sorted({w for w in {*now, *folded} if now.get(w) != folded.get(w)})
    if not changed:
        return []
    peaks = tables.scan(spark, root, "weekly_peaks")
    # The weeks between the newest stored one and new days are filled, too.
    first = min([changed[0], *([max(folded) + WEEK] if folded else [])])
    last = max({*now, *folded})
    days = [w + dt.timedelta(days=i) for w in changed for i in range(7)]
    metrics = tables.scan(spark, root, "metrics_daily").where(F.col("metric_date").isin(days))
    since = peaks.where((F.col("week") >= F.lit(first)) & ~F.col("week").isin(changed) & F.col("seen"))
    own = weekly.own_peaks(metrics).unionByName(since.select("song_id", "week", "peak"))
    before = peaks.where(F.col("week") == F.lit(first - WEEK))
    tables.write_table(materialize(weekly.rolled_peaks(before, own, first, last)), root, "weekly_peaks")
    marks = [(w, now.get(w, "")) for w in changed]
    tables.write_table(spark.createDataFrame(marks, "week date, files string"), root, "folded_weeks")
    return changed
