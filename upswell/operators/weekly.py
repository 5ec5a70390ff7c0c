"""Weekly velocities, derivative counts, cold start and co-tag clusters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upswell.fixed_values import CLUSTER_MIN_SONGS, MIN_WEEKS, TOP_N
from upswell.functions.scores import (
    confirmed_canon,
    deriv_velocity,
    is_coldstart,
    monday,
    view_velocity,
    week_start,
)
from upswell.operators.ranking import top_n, top_n_per
from upswell.session import materialize

WEEK = dt.timedelta(days=7)


def _weekly_peaks(metrics: DataFrame, source: str | None) -> DataFrame:
    """Highest reading per song and week: at most one row per song and week follows.

    All later steps work on these rows, so a song with very many readings is
    reduced in the map tasks and never met whole.
    """
    if source is not None:
        metrics = metrics.where(F.col("source") == source)
    return metrics.groupBy("song_id", week_start(F.col("metric_date")).alias("_wk")).agg(
        F.max("views").alias("_peak")
    )


def view_deltas(metrics: DataFrame, week: dt.date | str, source: str | None = None) -> DataFrame:
    """Per song: peak views before the week, before its end and a week earlier.

    ``weeks`` counts the weeks with any reading. Weeks start on Monday, so "before
    a boundary" is a comparison of weeks and one small row per song and week is enough.
    """
    start = monday(week)
    wk, peak = F.col("_wk"), F.col("_peak")
    before_end = wk < F.lit(start + WEEK)
    return _weekly_peaks(metrics, source).groupBy("song_id").agg(
        F.max(F.when(wk < F.lit(start - WEEK), peak)).alias("v_prev"),
        F.max(F.when(wk < F.lit(start), peak)).alias("v_start"),
        F.max(F.when(before_end, peak)).alias("v_end"),
        F.count(F.when(before_end, 1)).alias("weeks"),
    )


def own_peaks(metrics: DataFrame) -> DataFrame:
    """``song_id, week, peak``: the highest reading of every song and week that has one."""
    return _weekly_peaks(metrics, None).select("song_id", F.col("_wk").alias("week"), F.col("_peak").alias("peak"))


def rolled_peaks(before: DataFrame, own: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Running peaks of the weeks from ``first`` to ``last``: the rows of ``weekly_peaks``.

    ``before`` has the rows of the week before ``first``, ``own`` the peaks of the weeks
    themselves. A song has a row for every week since its first reading: ``seen`` and
    ``peak`` of the week alone, ``best`` and ``weeks`` of all weeks so far. One shuffle by
    song, of one row per song and week.
    """
    entry = lambda day, peak, n, own: F.struct(
        day.alias("day"), peak.cast("bigint").alias("peak"), F.lit(n).cast("bigint").alias("n") if isinstance(n, int) else n.cast("bigint").alias("n"), F.lit(own).alias("own")
    )
    nothing = F.lit(None)
    marks = F.transform(_weeks_between(first, last), lambda w: entry(F.unix_date(w), nothing, 0, 0))
    start = F.lit(first)
    old = before.select("song_id", F.explode(F.concat(F.array(entry(F.unix_date(start) - 7, F.col("best"), F.col("weeks"), 2)), marks)).alias("e"))
    new = own.select("song_id", entry(F.unix_date("week"), F.col("peak"), 1, 1).alias("e"))
    # Songs without a row before ``first`` get their weeks from their own first reading on.
    fresh = own.select("song_id").distinct().join(before.select("song_id"), "song_id", "left_anti")
    rows = old.unionByName(new).unionByName(fresh.select("song_id", F.explode(marks).alias("e"))).select("song_id", "e.*")
    until = Window.partitionBy("song_id").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("song_id").orderBy("day").rangeBetween(0, 0)
    filled = rows.select(
        "song_id",
        F.date_from_unix_date("day").alias("week"),
        "own",
        (F.max(F.when(F.col("own") == 1, 1)).over(same) == 1).alias("seen"),
        F.max(F.when(F.col("own") == 1, F.col("peak"))).over(same).alias("peak"),
        F.max("peak").over(until).alias("best"),
        F.sum("n").over(until).alias("weeks"),
    )
    kept = filled.where((F.col("own") == 0) & (F.col("weeks") > 0))
    return kept.select("song_id", "week", F.coalesce("seen", F.lit(False)).alias("seen"), "peak", "best", "weeks")


def kept_deltas(peaks: DataFrame, first: dt.date | str, last: dt.date | str) -> DataFrame:
    """``view_deltas`` of every week of a range, with ``week``, from stored running peaks.

    Reads the rows of these weeks, of two before and of the newest week: no daily reading.
    ``peaks`` must hold the newest week that has readings; later weeks are as that one.
    """
    first, last = monday(first), monday(last)
    newest = peaks.agg(F.max("week")).scalar()
    asked = F.explode(_weeks_between(first, last)).alias("week")
    none = F.lit(None).cast("bigint")
    # Every song has its rows, also in weeks before its first reading.
    every = peaks.where(F.col("week") == newest).select("song_id", asked, F.lit(-1).alias("ago"), none.alias("best"), none.alias("weeks"))
    of_range = (F.col("week") >= F.lit(first - 2 * WEEK)) & (F.col("week") <= F.lit(last))
    near = peaks.where(of_range | (F.col("week") == newest))
    onwards = F.sequence("week", F.greatest("week", F.lit(last)), F.expr("interval 7 days"))
    until = F.explode(F.when(F.col("week") == newest, onwards).otherwise(F.array("week"))).alias("_wk")
    enters = near.select("song_id", until, "best", "weeks").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("ago"))
    enters = enters.select("song_id", F.date_add("_wk", F.col("ago") * 7).alias("week"), "ago", "best", "weeks")
    both = enters.where((F.col("week") >= F.lit(first)) & (F.col("week") <= F.lit(last))).unionByName(every)
    at = lambda n, c: F.max(F.when(F.col("ago") == n, F.col(c)))
    return both.groupBy("song_id", "week").agg(
        at(2, "best").alias("v_prev"),
        at(1, "best").alias("v_start"),
        at(0, "best").alias("v_end"),
        F.coalesce(at(0, "weeks"), F.lit(0)).cast("bigint").alias("weeks"),
    )


def deriv_counts(derived: DataFrame) -> DataFrame:
    """New derived works per original and week of discovery."""
    return derived.groupBy(
        F.col("original_song_id").alias("song_id"),
        week_start(F.col("discovered_at")).alias("week"),
    ).agg(F.count(F.lit(1)).alias("n"))


def deriv_base(derived: DataFrame, week: dt.date | str, span: int = 4) -> DataFrame:
    """Per original: works found in the week and in the ``span`` weeks before it.

    Weeks without a row count as 0, so the sum over the range is all the mean needs.
    """
    start = monday(week)
    found = F.col("discovered_at")
    recent = derived.where(
        (found >= F.lit(start - span * WEEK).cast("timestamp"))
        & (found < F.lit(start + WEEK).cast("timestamp"))
    )
    now = found >= F.lit(start).cast("timestamp")
    return recent.groupBy(F.col("original_song_id").alias("song_id")).agg(
        F.count(F.when(now, 1)).alias("n_this"),
        F.count(F.when(~now, 1)).alias("n_prev"),
    )


def tag_map(song_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct (song, confirmed canonical tag)."""
    confirmed = tags.where(confirmed_canon(F.col("canon_status"), F.col("canon_name"))).select(
        F.col("id").alias("tag_id"), F.col("canon_name").alias("canon")
    )
    return song_tags.join(confirmed, "tag_id").select("song_id", "canon").distinct()


def _velocity(v_prev: Column, v_start: Column, v_end: Column) -> Column:
    """Velocity from three readings; without the oldest there is no baseline."""
    baseline = F.when(v_prev.isNotNull(), v_start - v_prev).otherwise(F.lit(0))
    return F.when(v_end.isNotNull() & v_start.isNotNull(), view_velocity(baseline, v_end - v_start))


def score(views: DataFrame, derivs: DataFrame, min_weeks: int = MIN_WEEKS) -> DataFrame:
    """Velocities per song with metrics; cold songs carry NULLs."""
    cold = is_coldstart(F.col("weeks"), min_weeks)
    vv = _velocity(F.col("v_prev"), F.col("v_start"), F.col("v_end"))
    dv = deriv_velocity(F.coalesce("n_prev", F.lit(0)), F.coalesce("n_this", F.lit(0)))
    return views.join(derivs, "song_id", "left").select(
        "song_id",
        F.when(~cold, vv).alias("view_velocity"),
        F.when(~cold, dv).alias("deriv_velocity"),
        cold.alias("is_coldstart"),
    )


def top_velocity(scored: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` fastest songs; equal velocities rank by song id."""
    moving = scored.where(F.col("view_velocity").isNotNull())
    return top_n(
        moving.select("song_id", "view_velocity"), n, F.desc("view_velocity"), F.asc("song_id")
    )


def tag_pairs(tagged: DataFrame, min_songs: int = 1) -> DataFrame:
    """Tag pairs on one song and how many songs carry them.

    A pair can reach ``min_songs`` only if both tags do, so the links of rarer tags leave
    first: a semi-join with the common tags. These are written before, so their size is known:
    the optimizer broadcasts them, and links then move by song only, or, if they are many,
    adaptive execution splits the join at a hot tag. A song's remaining tags, which
    are distinct terms, meet in one row and are paired there.
    """
    if min_songs > 1:
        common = tagged.groupBy("canon").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_songs)
        tagged = tagged.join(materialize(common.select("canon")), "canon", "left_semi")
    per_song = tagged.groupBy("song_id").agg(F.sort_array(F.collect_list("canon")).alias("_all"))
    first = per_song.select("_all", F.posexplode("_all").alias("_at", "tag_a"))
    pairs = first.select(
        "tag_a", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("tag_b")
    )
    counted = pairs.groupBy("tag_a", "tag_b").agg(F.count(F.lit(1)).alias("songs"))
    return counted.where(F.col("songs") >= min_songs)


def tags_of(top: DataFrame, song_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """``tag_map`` of the top songs only.

    A top list has a fixed number of songs, so it broadcasts and the links are
    filtered in their scan; nothing of the link table is shuffled for other songs.
    """
    listed = F.broadcast(top.select("song_id").distinct())
    return tag_map(song_tags.join(listed, "song_id", "left_semi"), tags)


def detect_clusters(
    top: DataFrame,
    tagged: DataFrame,
    min_songs: int = CLUSTER_MIN_SONGS,
    pair_size: int = 2,
    by: list[str] | None = None,
) -> DataFrame:
    """Tag combinations carried by at least ``min_songs`` of the top songs.

    ``top`` has ``song_id, rank`` (and the columns in ``by``, each value a separate
    top list). Grows combinations one tag at a time and keeps only those that still
    have enough songs, since a larger one cannot have more. Result: ``by, tags,
    songs`` (songs by rank) and ``cluster_id``, numbered by the rank of the first
    song carrying the combination, then by its tags.
    """
    by = by or []
    song = [*by, "song_id", "rank"]
    # A top list has a fixed number of songs, so it broadcasts whatever the tag table's size.
    base = tagged.join(F.broadcast(top.select(*song)), "song_id").select(*song, "canon")
    carriers = F.count(F.lit(1)).over(Window.partitionBy(*by, "canon"))
    common = base.withColumn("_n", carriers).where(F.col("_n") >= min_songs)
    grown = common.groupBy(*song).agg(F.array_sort(F.collect_list("canon")).alias("_all")).select(
        *song, "_all", F.posexplode("_all").alias("_at", "_tag")
    )
    grown = grown.select(*song, "_all", "_at", F.array("_tag").alias("tags"))
    together = F.count(F.lit(1)).over(Window.partitionBy(*by, "tags"))
    for size in range(2, pair_size + 1):
        later = F.transform("_all", lambda tag, at: F.struct(at.alias("at"), tag.alias("tag")))
        after = F.filter(later, lambda t: t["at"] > F.col("_at"))
        grown = grown.select(*song, "_all", "tags", F.explode(after).alias("_next")).select(
            *song,
            "_all",
            F.col("_next.at").alias("_at"),
            F.array_append("tags", F.col("_next.tag")).alias("tags"),
        )
        if size < pair_size:
            grown = grown.withColumn("_n", together).where(F.col("_n") >= min_songs)
    found = grown.groupBy(*by, "tags").agg(
        F.array_sort(F.collect_list(F.struct("rank", "song_id"))).alias("_members")
    ).where(F.size("_members") >= min_songs)
    order = Window.partitionBy(*by).orderBy(F.col("_members")[0]["rank"], F.col("tags"))
    return found.select(
        *by,
        "tags",
        F.col("_members.song_id").alias("songs"),
        F.row_number().over(order).alias("cluster_id"),
    )


def cluster_of(clusters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First cluster of every clustered song."""
    by = by or []
    members = clusters.select(*by, F.explode("songs").alias("song_id"), "cluster_id")
    return members.groupBy(*by, "song_id").agg(F.min("cluster_id").alias("cluster_id"))


def trend_rows(
    metrics: DataFrame,
    derived: DataFrame,
    song_tags: DataFrame,
    tags: DataFrame,
    week: dt.date | str,
    top: int = TOP_N,
    cluster_min_songs: int = CLUSTER_MIN_SONGS,
    source: str | None = None,
) -> DataFrame:
    """Scores of one week: one row per song that has metrics."""
    views = view_deltas(metrics, week, source)
    return week_rows(views, derived, song_tags, tags, week, top, cluster_min_songs)


def week_rows(
    views: DataFrame,
    derived: DataFrame,
    song_tags: DataFrame,
    tags: DataFrame,
    week: dt.date | str,
    top: int = TOP_N,
    cluster_min_songs: int = CLUSTER_MIN_SONGS,
) -> DataFrame:
    """Scores of one week from its ``view_deltas``."""
    start = monday(week)
    scored = score(views, deriv_base(derived, start))
    leaders = top_velocity(scored, top)
    clusters = detect_clusters(leaders, tags_of(leaders, song_tags, tags), cluster_min_songs)
    # At most ``top`` rows, so the broadcast is bounded by the parameter.
    numbered = F.broadcast(cluster_of(clusters))
    return scored.join(numbered, "song_id", "left").select(
        "song_id",
        F.lit(start).alias("week"),
        "view_velocity",
        "deriv_velocity",
        "is_coldstart",
        "cluster_id",
    )


def _weeks_between(first: dt.date, last: dt.date) -> Column:
    return F.sequence(F.lit(first), F.lit(last), F.expr("interval 7 days"))


def trend_range(
    metrics: DataFrame,
    derived: DataFrame,
    song_tags: DataFrame,
    tags: DataFrame,
    first_week: dt.date | str,
    last_week: dt.date | str,
    top: int = TOP_N,
    cluster_min_songs: int = CLUSTER_MIN_SONGS,
    source: str | None = None,
) -> DataFrame:
    """The same scores for every week of a range, in one pass over the metrics.

    Readings become weekly peaks; a window over a song's weeks carries the running
    peak and the number of weeks. A song's first peak also brings one row without a
    reading for every asked week, where that window finds the week's boundaries.
    """
    first, last = monday(first_week), monday(last_week)
    peaks = _weekly_peaks(metrics, source)
    is_first = F.row_number().over(Window.partitionBy("song_id").orderBy("_wk")) == 1

    def entry(wk: Column, peak: Column, seen: int) -> Column:
        return F.struct(wk.alias("_wk"), peak.alias("_peak"), F.lit(seen).alias("_seen"))

    own = F.array(entry(F.col("_wk"), F.col("_peak"), 1))
    asked = F.transform(
        _weeks_between(first, last), lambda w: entry(w, F.lit(None).cast("bigint"), 0)
    )
    spine = (
        peaks.withColumn("_first", is_first)
        .select(
            "song_id",
            F.explode(F.when(F.col("_first"), F.concat(own, asked)).otherwise(own)).alias("_e"),
        )
        .select("song_id", "_e.*")
        .withColumn("_day", F.unix_date("_wk"))
    )
    past = Window.partitionBy("song_id").orderBy("_day")
    ever = Window.unboundedPreceding
    filled = spine.select(
        "song_id",
        F.col("_wk").alias("week"),
        "_seen",
        F.max("_peak").over(past.rangeBetween(ever, -14)).alias("v_prev"),
        F.max("_peak").over(past.rangeBetween(ever, -7)).alias("v_start"),
        F.max("_peak").over(past.rangeBetween(ever, 0)).alias("v_end"),
        F.sum("_seen").over(past.rangeBetween(ever, 0)).alias("weeks"),
    )
    views = filled.where(F.col("_seen") == 0)
    return range_rows(views, derived, song_tags, tags, first, last, top, cluster_min_songs)


def range_rows(
    views: DataFrame,
    derived: DataFrame,
    song_tags: DataFrame,
    tags: DataFrame,
    first: dt.date,
    last: dt.date,
    top: int = TOP_N,
    cluster_min_songs: int = CLUSTER_MIN_SONGS,
) -> DataFrame:
    """Scores of every week of a range from ``view_deltas`` of its weeks."""
    found = F.col("discovered_at")
    near = derived.where(
        (found >= F.lit(first - 4 * WEEK).cast("timestamp"))
        & (found < F.lit(last + WEEK).cast("timestamp"))
    )
    reach = deriv_counts(near).select(
        "song_id", "n", "week", F.posexplode(_weeks_ahead()).alias("_ago", "_days")
    )
    reach = reach.select(
        "song_id", F.date_add("week", F.col("_days")).alias("week"), "n", "_ago"
    )
    derivs = reach.groupBy("song_id", "week").agg(
        F.sum(F.when(F.col("_ago") == 0, F.col("n")).otherwise(0)).alias("n_this"),
        F.sum(F.when(F.col("_ago") > 0, F.col("n")).otherwise(0)).alias("n_prev"),
    )
    cold = is_coldstart(F.col("weeks"))
    scored = views.join(derivs, ["song_id", "week"], "left").select(
        "song_id",
        "week",
        F.when(~cold, _velocity(F.col("v_prev"), F.col("v_start"), F.col("v_end"))).alias("view_velocity"),
        F.when(
            ~cold, deriv_velocity(F.coalesce("n_prev", F.lit(0)), F.coalesce("n_this", F.lit(0)))
        ).alias("deriv_velocity"),
        cold.alias("is_coldstart"),
    )
    leaders = top_n_per(
        scored.where(F.col("view_velocity").isNotNull()).select("week", "song_id", "view_velocity"),
        ["week"], top, F.desc("view_velocity"), F.asc("song_id"),
    )
    tagged = tags_of(leaders, song_tags, tags)
    clusters = detect_clusters(leaders, tagged, cluster_min_songs, by=["week"])
    # At most ``top`` rows for each asked week.
    numbered = F.broadcast(cluster_of(clusters, by=["week"]))
    return scored.join(numbered, ["week", "song_id"], "left").select(
        "song_id", "week", "view_velocity", "deriv_velocity", "is_coldstart", "cluster_id"
    )


def _weeks_ahead() -> Column:
    """Days from a discovery week to the five weeks whose score it enters."""
    return F.array(*[F.lit(7 * i) for i in range(5)])


def trend_summary(rows: DataFrame) -> DataFrame:
    """Scored, cold and clustered songs per week."""
    return rows.groupBy("week").agg(
        F.count_if(~F.col("is_coldstart")).alias("scored"),
        F.count_if("is_coldstart").alias("coldstart"),
        F.count("cluster_id").alias("clustered"),
    )
