"""Tag shares among newly published songs, week over week."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.fixed_values import TOP_N
from upswell.functions.scores import confirmed_canon, monday, tag_share, tag_share_delta

WEEK = dt.timedelta(days=7)


def _published(songs: DataFrame, start: dt.date) -> DataFrame:
    """Songs of the week and of the week before, with a flag for the former."""
    day = F.col("publish_date")
    both = songs.where((day >= F.lit(start - WEEK)) & (day < F.lit(start + WEEK)))
    return both.select(F.col("id").alias("song_id"), (day >= F.lit(start)).alias("is_this"))


def week_totals(songs: DataFrame, week: dt.date | str) -> DataFrame:
    """One row: songs published in the week and in the week before."""
    return _published(songs, monday(week)).agg(
        F.count_if("is_this").alias("total_this"),
        F.count_if(~F.col("is_this")).alias("total_prev"),
    )


def song_canons(songs: DataFrame, song_tags: DataFrame, tags: DataFrame, week: dt.date | str) -> DataFrame:
    """Distinct (canonical tag, song) for songs of the two weeks.

    Songs are filtered by date first, so the tag links shrink at the first join.
    """
    confirmed = tags.where(confirmed_canon(F.col("canon_status"), F.col("canon_name"))).select(
        F.col("id").alias("tag_id"), F.col("canon_name").alias("canon")
    )
    recent = song_tags.join(_published(songs, monday(week)), "song_id")
    return recent.join(confirmed, "tag_id").select("canon", "song_id", "is_this").distinct()


def tag_week_counts(songs: DataFrame, song_tags: DataFrame, tags: DataFrame, week: dt.date | str) -> DataFrame:
    """Songs per canonical tag for both weeks in one pass.

    The distinct rows are spread by (tag, song) and counted in the map tasks, so a
    tag on a third of all songs does not end in one task.
    """
    return song_canons(songs, song_tags, tags, week).groupBy("canon").agg(
        F.count_if("is_this").alias("n_this"),
        F.count_if(~F.col("is_this")).alias("n_prev"),
    )


def all_tag_shares(songs: DataFrame, song_tags: DataFrame, tags: DataFrame, week: dt.date | str) -> DataFrame:
    """Share this week and change against last week for every tag used this week."""
    # One subquery for both totals.
    totals = week_totals(songs, week).select(F.struct("total_this", "total_prev")).scalar()
    counts = tag_week_counts(songs, song_tags, tags, week).where(F.col("n_this") > 0)
    this = tag_share(F.col("n_this"), totals["total_this"])
    prev = tag_share(F.col("n_prev"), totals["total_prev"])
    return counts.select(
        "canon",
        F.bround(this, 1).alias("share_pct"),
        F.bround(tag_share_delta(prev, this), 1).alias("delta_pp"),
    )


def tag_deltas(
    songs: DataFrame, song_tags: DataFrame, tags: DataFrame, week: dt.date | str, n: int = TOP_N
) -> DataFrame:
    """The ``n`` tags whose share grew most; equal changes rank by tag."""
    shares = all_tag_shares(songs, song_tags, tags, week)
    return shares.orderBy(F.desc("delta_pp"), F.asc("canon")).limit(n)
