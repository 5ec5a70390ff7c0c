"""Run checks and cost rollups: small results over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.fixed_values import (
    CANON_FLASH,
    CANON_LITE,
    DAILY_QUOTA,
    DEMOTED,
    PENDING,
    STATUSES,
)
from upswell.functions.scores import monday, ratio

WEEK = dt.timedelta(days=7)


def status_counts(tags: DataFrame) -> DataFrame:
    """Tags per canon status."""
    return tags.groupBy("canon_status").agg(F.count(F.lit(1)).alias("n"))


def status_rollup(tags: DataFrame) -> DataFrame:
    """One row of cache and tier rates; unknown statuses are not counted."""
    counts = tags.agg(
        *[F.count_if(F.col("canon_status") == s).alias(s) for s in STATUSES]
    )
    accepted = F.col(CANON_LITE) + F.col(CANON_FLASH)
    total = accepted + F.col(PENDING) + F.col(DEMOTED)
    return counts.select(
        total.alias("total"),
        F.col(CANON_LITE).alias("lite"),
        F.col(CANON_FLASH).alias("flash"),
        F.col(DEMOTED).alias("demoted"),
        F.col(PENDING).alias("pending"),
        ratio(accepted, total).alias("cache_hit_rate"),
        F.col(PENDING).alias("pending_backlog"),
        ratio(F.col(CANON_FLASH), accepted).alias("escalation_rate"),
        ratio(F.col(DEMOTED), accepted + F.col(DEMOTED)).alias("demotion_rate"),
    )


def _quota(model: Column, quotas: dict[str, int]) -> Column:
    """Daily quota of a model as an expression, NULL for models outside the tiers."""
    branch = None
    for name, calls in quotas.items():
        branch = F.when(model == name, F.lit(calls)) if branch is None else branch.when(model == name, F.lit(calls))
    return branch


def span_rollup(spans: DataFrame, quotas: dict[str, int] = DAILY_QUOTA) -> DataFrame:
    """Calls, tokens and use of the daily quota per model.

    Models without a quota are off-tier: only their calls count. A span without a
    model is left out.
    """
    per_model = spans.where(F.col("model").isNotNull()).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("_tokens"),
    )
    quota = _quota(F.col("model"), quotas)
    return per_model.select(
        "model",
        quota.isNull().alias("off_tier"),
        "calls",
        F.when(quota.isNotNull(), F.col("_tokens")).alias("tokens"),
        F.bround(F.lit(100.0) * F.col("calls") / quota, 1).alias("quota_pct"),
    )


def agreement_rate(log: DataFrame) -> DataFrame:
    """How often the second tier confirmed the first tier's proposal; one row."""
    pairs = log.where((F.col("status") == CANON_FLASH) & F.col("lite_canon").isNotNull())
    counts = pairs.agg(
        F.count(F.lit(1)).alias("escalation_pairs"),
        F.count_if(F.col("canon_name") == F.col("lite_canon")).alias("agreed"),
    )
    rate = F.when(F.col("escalation_pairs") > 0, ratio(F.col("agreed"), F.col("escalation_pairs")))
    return counts.select("escalation_pairs", "agreed", rate.alias("agreement_rate"))


def fetch_sanity(songs: DataFrame, metrics: DataFrame, week: dt.date | str) -> DataFrame:
    """One row: what the week has to score, and why a run would stop."""
    start = monday(week)
    day = F.col("metric_date")
    in_week = metrics.where((day >= F.lit(start)) & (day < F.lit(start + WEEK)))
    # One row per day at most, so the distinct count needs no second pass.
    per_day = in_week.groupBy("metric_date").agg(F.count(F.lit(1)).alias("n"))
    week_counts = per_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("week_metrics"),
        F.count(F.lit(1)).alias("week_days"),
    )
    n_songs = songs.agg(F.count(F.lit(1))).scalar()
    halted = F.when(F.col("songs") == 0, "no_songs").when(
        F.col("week_metrics") == 0, "no_metrics_this_week"
    )
    return week_counts.select(n_songs.alias("songs"), "week_metrics", "week_days").withColumn(
        "halted", halted
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row: results per status, zero where there are none, and their total."""
    return results.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count(F.lit(1)).alias("total"),
    )
