"""The weekly evidence snapshot: four small reports and one nested row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.fixed_values import TOP_N
from upswell.functions.scores import monday, round2
from upswell.operators import upserts
from upswell.operators.ranking import top_n


def scores_with_titles(scores: DataFrame, songs: DataFrame, week: dt.date | str) -> DataFrame:
    """Scores of one week with title and publication date of the song."""
    named = songs.select(F.col("id").alias("song_id"), "title", "publish_date")
    return scores.where(F.col("week") == F.lit(monday(week))).join(named, "song_id")


def evidence_top(scores: DataFrame, songs: DataFrame, week: dt.date | str, n: int = TOP_N) -> DataFrame:
    """The fastest songs of the week: ``rank, song_id, title``, velocities and cluster."""
    rows = scores_with_titles(scores, songs, week).where(
        ~F.col("is_coldstart") & F.col("view_velocity").isNotNull()
    )
    best = top_n(
        rows.select("song_id", "title", "view_velocity", "deriv_velocity", "cluster_id"),
        n, F.desc("view_velocity"), F.asc("song_id"),
    )
    return best.select(
        "rank",
        "song_id",
        "title",
        round2(F.col("view_velocity")).alias("view_velocity"),
        round2(F.col("deriv_velocity")).alias("deriv_velocity"),
        "cluster_id",
    )


def cluster_titles(scores: DataFrame, songs: DataFrame, week: dt.date | str) -> DataFrame:
    """Titles per cluster, fastest first. Clusters hold top songs only, so groups are small."""
    rows = scores_with_titles(scores, songs, week).where(F.col("cluster_id").isNotNull())
    member = F.struct(
        (-F.col("view_velocity")).alias("order"), F.col("song_id"), F.col("title")
    )
    grouped = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(member)).alias("_m"))
    return grouped.select("cluster_id", F.col("_m.title").alias("titles"))


def watchlist(scores: DataFrame, songs: DataFrame, week: dt.date | str, n: int = TOP_N) -> DataFrame:
    """Cold songs, latest first; songs without a date lead the list."""
    rows = scores_with_titles(scores, songs, week).where("is_coldstart")
    return top_n(
        rows.select("song_id", "title", "publish_date"),
        n, F.desc_nulls_first("publish_date"), F.asc("song_id"),
    ).select("rank", "song_id", "title")


def _listed(df: DataFrame, order: list[str], *fields: str) -> Column:
    """A short report as one array of structs in ``order``."""
    row = F.struct(F.struct(*order).alias("_order"), F.struct(*fields).alias("row"))
    return df.agg(F.array_sort(F.collect_list(row))["row"]).scalar()


def evidence(
    scores: DataFrame, songs: DataFrame, deltas: DataFrame, week: dt.date | str, n: int = TOP_N
) -> DataFrame:
    """One row for the week; ``deltas`` are its tag deltas. Every list is a top-n report."""
    start = monday(week)
    growth = deltas.withColumn("_fall", -F.col("delta_pp"))
    spark = scores.sparkSession
    return spark.range(1).select(
        F.lit(start).alias("week"),
        _listed(
            evidence_top(scores, songs, start, n), ["rank"],
            "song_id", "title", "view_velocity", "deriv_velocity", "cluster_id",
        ).alias("top_songs"),
        _listed(growth, ["_fall", "canon"], "canon", "share_pct", "delta_pp").alias("tag_deltas"),
        _listed(
            cluster_titles(scores, songs, start), ["cluster_id"], "cluster_id", "titles"
        ).alias("clusters"),
        _listed(watchlist(scores, songs, start, n), ["rank"], "song_id", "title").alias("watchlist"),
    )


def evidence_json(snapshot: DataFrame) -> DataFrame:
    """``week`` and the snapshot as JSON; absent values stay visible as nulls."""
    fields = ["week", "top_songs", "tag_deltas", "clusters", "watchlist"]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return snapshot.select("week", body.alias("evidence"))


def report_rows(snapshot: DataFrame, narrative: Column, model: str, run_at: Column) -> DataFrame:
    """Rows of the report table; the narrative is supplied by the caller."""
    return evidence_json(snapshot).select(
        "week",
        narrative.alias("narrative"),
        "evidence",
        F.lit(model).alias("model"),
        run_at.alias("generated_at"),
    )


def report_upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One report per week; the newer run replaces it."""
    return upserts.update_all(stored, fresh, ["week"])
