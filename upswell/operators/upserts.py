"""Idempotent table maintenance: every function returns the table after the write.

Joins are written so that the stored table is never the side that has to be
collected: a small batch of updates broadcasts by its own statistics and the
table is only scanned; a large one falls back to a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.fixed_values import CONFIRMED, DEMOTED, PENDING
from upswell.session import materialize


def last_wins(df: DataFrame, keys: Sequence[str], seq: Column) -> DataFrame:
    """One row per key: the one latest in ``seq``. Hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_latest"))
    return latest.select(*keys, "_latest.*").select(*df.columns)


def new_rows(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update rows whose key the base does not hold: what an append has to write."""
    known = base.select(*keys).join(updates.select(*keys), list(keys), "left_semi")
    return updates.join(known, list(keys), "left_anti")


def insert_only(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows stay as they are; unknown keys are added once."""
    fresh = new_rows(base, updates.dropDuplicates(list(keys)), keys)
    return base.unionByName(fresh.select(*base.columns))


def keep_first(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], seen_at: str
) -> DataFrame:
    """As ``insert_only``; among new rows with one key the earliest ``seen_at`` stays."""
    rest = [c for c in updates.columns if c not in keys]
    first = updates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seen_at)).alias("_first"))
    fresh = new_rows(base, first.select(*keys, "_first.*"), keys)
    return base.unionByName(fresh.select(*base.columns))


def update_all(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Updates replace whole rows or are inserted."""
    kept = base.join(updates.select(*keys), list(keys), "left_anti")
    return kept.unionByName(updates.select(*base.columns))


def update_some(
    base: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    defaults: dict[str, Column],
) -> DataFrame:
    """Updates overwrite only ``columns``; other columns of known rows stay.

    New rows take ``defaults`` for the columns an update does not own.
    """
    changed = updates.select(*keys, F.struct(*columns).alias("_new"))
    merged = base.join(changed, list(keys), "left").select(
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in base.columns
        ]
    )
    fresh = new_rows(base, updates, keys).select(
        *[
            F.col(c) if c in columns or c in keys
            else defaults.get(c, F.lit(None)).cast(base.schema[c].dataType).alias(c)
            for c in base.columns
        ]
    )
    return merged.unionByName(fresh)


def upsert_tags(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Names and categories from the catalogue; the canon columns are never touched."""
    return update_some(
        base, updates, ["id"], ["name", "category"], {"canon_status": F.lit(PENDING)}
    )


def linked(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent exists."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_semi").select(*child.columns)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_anti").select(*child.columns)


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``id`` of everything that hangs on the ids of ``start``, these included: each once.

    ``edges`` has ``parent, child``. A round follows the edges of the ids found in the round
    before and keeps those not met yet, so circles end, and the rounds are as many as the
    longest chain has links. Each round is written: plans stay short, and a lost executor
    costs one round.
    """
    edges = materialize(edges.select("parent", "child").where("parent is not null and child is not null").distinct())
    known = newest = materialize(start.select("id").where("id is not null").distinct())
    while True:
        # Edges of a hot parent are split by adaptive execution; its children are folded before they move on.
        below = edges.join(newest, edges.parent == newest.id, "left_semi").select(F.col("child").alias("id")).distinct()
        newest = materialize(below.join(known, "id", "left_anti"))
        if newest.isEmpty():
            return known
        known = materialize(known.unionByName(newest))


def canon_apply(tags: DataFrame, results: DataFrame) -> DataFrame:
    """Applies routing results: accepted rows get a canon, demoted only a status.

    ``results`` has ``id, status, canon_name, confidence``; pending rows change nothing.
    """
    moved = results.where(F.col("status").isin(*CONFIRMED, DEMOTED)).select(
        "id",
        F.struct("status", "canon_name", "confidence").alias("_r"),
    )
    accepted = F.coalesce(F.col("_r.status").isin(*CONFIRMED), F.lit(False))
    swap = {
        "canon_name": F.when(accepted, F.col("_r.canon_name")).otherwise(F.col("canon_name")),
        "canon_confidence": F.when(accepted, F.col("_r.confidence"))
        .otherwise(F.col("canon_confidence"))
        .cast(tags.schema["canon_confidence"].dataType),
        "canon_status": F.coalesce(F.col("_r.status"), F.col("canon_status")),
    }
    joined = tags.join(moved, "id", "left")
    return joined.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in tags.columns])
