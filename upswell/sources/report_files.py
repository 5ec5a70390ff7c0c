"""Publishing weekly reports as JSON."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upswell.functions.scores import monday
from upswell.session import file_system

_EVIDENCE = (
    "week string,"
    " top_songs array<struct<song_id:bigint,title:string,view_velocity:double,"
    "deriv_velocity:double,cluster_id:int>>,"
    " tag_deltas array<struct<canon:string,share_pct:double,delta_pp:double>>,"
    " clusters array<struct<cluster_id:int,titles:array<string>>>,"
    " watchlist array<struct<song_id:bigint,title:string>>"
)


def report_payload(reports: DataFrame) -> DataFrame:
    """``week`` and the whole published document of every report."""
    document = F.struct(
        F.col("week").cast("string").alias("week"),
        "narrative",
        F.from_json("evidence", _EVIDENCE).alias("evidence"),
        "model",
        F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("generated_at"),
    )
    return reports.select("week", F.to_json(document, {"ignoreNullFields": "false"}).alias("payload"))


def write_report_json(reports: DataFrame, week: dt.date | str, out_dir: str) -> list[str]:
    """Writes the week's document twice, as its own report and as the latest.

    Returns the files written; a week without a report writes nothing. A document is one
    row, so it may come to the driver. Readers see the old file or the new one.
    """
    start = monday(week)
    row = report_payload(reports.where(F.col("week") == F.lit(start))).select("payload").first()
    if row is None:
        return []
    targets = [f"{out_dir}/report-{start}.json", f"{out_dir}/latest.json"]
    for target in targets:
        replace_file(reports.sparkSession, target, row["payload"].encode())
    return targets


def replace_file(spark: SparkSession, target: str, data: bytes) -> None:
    """Puts ``data`` into a file in any store Spark knows: written aside, then renamed."""
    jvm = spark.sparkContext._jvm
    fs, where = file_system(spark, target)
    _, aside = file_system(spark, f"{target.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(data)
    finally:
        stream.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fs.makeQualified(aside), fs.makeQualified(where), overwrite)


def latest_payload(reports: DataFrame) -> DataFrame:
    """The document of the most recent week."""
    return report_payload(reports).agg(
        F.max("week").alias("week"), F.max_by("payload", "week").alias("payload")
    )
