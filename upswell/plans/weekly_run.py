"""The weekly run: check, canonicalize, score, report, publish."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.fixed_values import (
    CLUSTER_MIN_SONGS,
    CONFIDENCE_THRESHOLD,
    ESCALATION_CAP,
    FLASH_MODEL,
    TOP_N,
    WORK_LIMIT,
)
from upswell.functions.scores import monday
from upswell.operators import canon, evidence, rollups, routing, shares, upserts, weekly
from upswell.plans import kept_weeks
from upswell.plans.canon_run import ModelCall, normalize, normalize_growing
from upswell.session import materialize, stages
from upswell.sources import tables
from upswell.sources.report_files import write_report_json

#: Evidence JSON to narrative text; None defers the report.
Narrate = Callable[[str], "str | None"]


def materialize_trend(
    spark: SparkSession,
    root: str,
    week: dt.date | str,
    top: int = TOP_N,
    cluster_min_songs: int = CLUSTER_MIN_SONGS,
) -> DataFrame:
    """Scores the week and merges it into its partition of the score table.

    The readings come from the kept weekly peaks: of the daily ones those are read whose
    days have changed since the last run. Rows of songs the run no longer sees stay.
    Returns the one-row summary.
    """
    start = monday(week)
    kept_weeks.refresh(spark, root)
    stored = tables.scan_tables(spark, root)
    rows = materialize(
        weekly.week_rows(
            weekly.kept_deltas(stored["weekly_peaks"], start, start).drop("week"),
            stored["derived_works"],
            stored["song_tags"],
            stored["tags"],
            start,
            top,
            cluster_min_songs,
        ).withColumn("computed_at", F.current_timestamp())
    )
    _merge_scores(spark, root, rows)
    return weekly.trend_summary(rows)


def _merge_scores(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Upserts scores within the weeks they belong to."""
    stored = tables.touched(spark, root, "trend_scores", rows)
    tables.write_table(upserts.update_all(stored, rows, ["song_id", "week"]), root, "trend_scores")


def run_weekly(
    spark: SparkSession,
    root: str,
    week: dt.date | str,
    publish_dir: str,
    narrate: Narrate,
    model_call: ModelCall | None = None,
    limit: int | None = WORK_LIMIT,
    threshold: float = CONFIDENCE_THRESHOLD,
    cap: int = ESCALATION_CAP,
    batches_per_round: int | None = 1,
    top: int = TOP_N,
    cluster_min_songs: int = CLUSTER_MIN_SONGS,
) -> dict:
    """One weekly run over the tables under ``root``; returns its state.

    Stops early when there is nothing to score. Without a model function the tags
    stay as they are; without a narrative nothing is stored or published.

    ``limit`` is how many of the most used open tags the run asks about, None for all;
    ``cap`` how many of them may go to the second tier. Those that do are kept in the stored
    escalation log, one row per week and tag. ``batches_per_round`` is that of ``normalize``;
    None sends all batches at once and settles the strict order (``normalize_growing``). ``top`` bounds the lists of the report and the songs that
    clusters are looked for in. The folders of the run's steps are removed at its end.
    """
    with stages(spark):
        return _run_weekly(
            spark, root, monday(week), publish_dir, narrate, model_call,
            limit, threshold, cap, batches_per_round, top, cluster_min_songs,
        )


def _run_weekly(
    spark, root, start, publish_dir, narrate, model_call, limit, threshold, cap, batches_per_round, top, cluster_min_songs
) -> dict:
    stored = tables.scan_tables(spark, root)
    fetch = rollups.fetch_sanity(stored["songs"], stored["metrics_daily"], start).first().asDict()
    halted = fetch.pop("halted")
    state = {"week": start, "fetch": fetch, "halted": halted}
    if halted:
        return state
    if model_call is not None:
        if limit is None:
            queue = canon.full_queue(stored["tags"], stored["song_tags"])
        else:
            queue = canon.work_queue(stored["tags"], stored["song_tags"], limit)
        vocab = canon.vocabulary(stored["tags"])
        if batches_per_round is None:
            results, _ = normalize_growing(queue, vocab, model_call, threshold, cap)
        else:
            results, _ = normalize(queue, vocab, model_call, threshold, cap, batches_per_round)
        state["canon"] = rollups.run_summary(results).first().asDict()
        # Keyed by week and tag, and written before the tags: a run that dies in between asks
        # for the same tags again, and its rows replace those of the first attempt.
        log = materialize(routing.escalation_log(results, F.lit(str(start))))
        known = tables.touched(spark, root, "escalation_log", log)
        tables.write_table(upserts.update_all(known, log, ["run", "id"]), root, "escalation_log")
        part = tables.touched(spark, root, "tags", results)
        tables.write_table(upserts.canon_apply(part, results), root, "tags")
    state["trend"] = materialize_trend(spark, root, start, top, cluster_min_songs).drop("week").first()
    state["trend"] = state["trend"].asDict() if state["trend"] else {}
    stored = tables.scan_tables(spark, root)
    deltas = shares.tag_deltas(stored["songs"], stored["song_tags"], stored["tags"], start, top)
    snapshot = materialize(evidence.evidence(stored["trend_scores"], stored["songs"], deltas, start, top))
    text = narrate(evidence.evidence_json(snapshot).first()["evidence"])
    if text is None:
        return {**state, "report": None}
    fresh = evidence.report_rows(snapshot, F.lit(text), FLASH_MODEL, F.current_timestamp())
    tables.write_table(fresh, root, "weekly_reports")
    counts = snapshot.select(F.size("top_songs").alias("a"), F.size("tag_deltas").alias("b")).first()
    state["report"] = {"week": str(start), "chars": len(text), "top_songs": counts.a, "tag_deltas": counts.b}
    reports = tables.scan(spark, root, "weekly_reports")
    state["published"] = write_report_json(reports, start, publish_dir)
    return state


def backfill(
    spark: SparkSession, root: str, first_week: dt.date | str, last_week: dt.date | str
) -> None:
    """Scores every week of a range in one job and merges each into its partition."""
    first, last = monday(first_week), monday(last_week)
    with stages(spark):
        kept_weeks.refresh(spark, root)
        stored = tables.scan_tables(spark, root)
        rows = materialize(
            weekly.range_rows(
                weekly.kept_deltas(stored["weekly_peaks"], first, last),
                stored["derived_works"],
                stored["song_tags"],
                stored["tags"],
                first,
                last,
            ).withColumn("computed_at", F.current_timestamp())
        )
        _merge_scores(spark, root, rows)
