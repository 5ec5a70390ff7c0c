"""Removing entities together with all rows that refer to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.operators import upserts
from upswell.schemas import REFERS
from upswell.session import stages
from upswell.sources import tables


def remove(spark: SparkSession, root: str, table: str, ids: DataFrame, derived: bool = False) -> dict[str, int]:
    """Removes the rows of ``table`` with an ``id`` of ``ids`` and what refers to them; returns the counts.

    References are those of ``schemas.REFERS``. With ``derived``, songs derived from removed
    ones are removed, too, and so on along ``derived_works``; circles end. What refers goes
    before what it refers to: a run that dies in between leaves no reference to nothing, and
    running it again completes it.
    """
    if derived and table != "songs":
        raise ValueError("only songs are derived from each other")
    with stages(spark):
        if derived:
            works = tables.scan(spark, root, "derived_works")
            edges = works.select(F.col("original_song_id").alias("parent"), F.col("derived_song_id").alias("child"))
            ids = upserts.closure(edges, ids)
        counts = {child: tables.delete_rows(spark, root, child, column, ids) for child, column in REFERS[table]}
        return counts | {table: tables.delete_rows(spark, root, table, "id", ids)}
