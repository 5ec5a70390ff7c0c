"""Landed JSON documents: song pages, metric pages and trace spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.fixed_values import MAX_PAGES, PAGE_SIZE
from upswell.functions.documents import span_model, span_tokens
from upswell.operators.upserts import last_wins
from upswell.schemas import METRIC_PAGE, SONG_PAGE, SPAN


def read_pages(spark: SparkSession, path: str, schema, whole_files: bool = False) -> DataFrame:
    """JSON documents, one per line or one per file, with the file they came from.

    A broken document fails the read instead of turning into NULLs.
    """
    pages = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", whole_files).json(path)
    return pages.withColumn("page_file", F.col("_metadata.file_path"))


def _place(pages: DataFrame) -> Column:
    """Order of an entry among all pages: page number, file, position in the page."""
    return F.struct(*[c for c in ("page", "page_file") if c in pages.columns], "at")


def song_items(pages: DataFrame) -> DataFrame:
    """One row per song document: ``item`` and its place ``seq``."""
    return pages.select("*", F.posexplode("items").alias("at", "item")).select(
        _place(pages).alias("seq"), "item"
    )


def read_song_pages(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Song documents of all landed pages; a page without items gives no rows."""
    return song_items(read_pages(spark, path, SONG_PAGE, whole_files))


def page_coverage(
    pages: DataFrame, by: list[str], size: int = PAGE_SIZE, max_pages: int = MAX_PAGES
) -> DataFrame:
    """Per run: pages and documents landed, the announced total, and whether it is complete.

    A run is complete once a page was empty or its pages reach the total; it may
    also have stopped at the page limit.
    """
    n_items = F.coalesce(F.size("items"), F.lit(0))
    counted = pages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(n_items).alias("fetched"),
        F.max(F.coalesce("totalCount", F.lit(0))).alias("total_matching"),
        F.bool_or(n_items == 0).alias("_empty"),
    )
    complete = F.col("_empty") | (F.col("pages") * size >= F.col("total_matching"))
    return counted.select(
        *by,
        "pages",
        "fetched",
        "total_matching",
        complete.alias("complete"),
        (~complete & (F.col("pages") >= max_pages)).alias("at_limit"),
    )


def metric_readings(pages: DataFrame) -> DataFrame:
    """Readings per content id: rows without an id are left out, the last of an id wins.

    Counters the source did not send stay NULL.
    """
    rows = pages.select("*", F.posexplode("data").alias("at", "d")).select(
        _place(pages).alias("seq"),
        F.col("d.contentId").alias("content_id"),
        F.col("d.viewCounter").alias("views"),
        F.col("d.commentCounter").alias("comments"),
        F.col("d.mylistCounter").alias("mylists"),
        F.col("d.likeCounter").alias("likes"),
    )
    known = rows.where(F.col("content_id") != "")
    return last_wins(known, ["content_id"], F.col("seq")).drop("seq")


def read_metric_pages(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Readings of all landed metric pages."""
    return metric_readings(read_pages(spark, path, METRIC_PAGE, whole_files))


def model_spans(spans: DataFrame) -> DataFrame:
    """Model and tokens of the model-call spans; other kinds would count a call twice."""
    calls = spans.where(F.upper("spanKind") == "LLM")
    return calls.select(
        span_model(F.col("attributes")).alias("model"), span_tokens(F.col("attributes")).alias("tokens")
    )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Model-call spans of all landed trace files, one span per line."""
    return model_spans(spark.read.schema(SPAN).option("mode", "FAILFAST").json(path))
