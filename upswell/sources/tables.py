"""Reading and writing the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.schemas import DATED_BY, ID_RANGE, RANGED_BY, TABLES
from upswell.session import file_system, materialize


def _layout(table: str) -> tuple[str, Column] | None:
    """Partition column of a table and how it follows from a row, if it has one."""
    if table in DATED_BY:
        return DATED_BY[table], F.col(DATED_BY[table])
    if table in RANGED_BY:
        return "id_range", F.expr(f"{RANGED_BY[table]} div {ID_RANGE}")
    return None


def _stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One stored table with its declared schema; no inference, so no extra read."""
    schema = TABLES[table]
    if table in RANGED_BY:
        schema = T.StructType([*schema.fields, T.StructField("id_range", T.LongType())])
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One stored table."""
    return _stored(spark, root, table).select(*TABLES[table].names)


def scan_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All stored tables. Nothing is read before a query asks for columns."""
    return {table: scan(spark, root, table) for table in TABLES}


def touched(spark: SparkSession, root: str, table: str, updates: DataFrame) -> DataFrame:
    """Stored rows of the days, weeks or id ranges that ``updates`` falls in.

    The partition values, of which a batch of updates has few, become a literal
    filter: other partitions are neither listed nor read.
    """
    column, value = _layout(table)
    parts = [row[0] for row in updates.select(value.alias("part")).distinct().collect()]
    return _stored(spark, root, table).where(F.col(column).isin(parts)).select(*TABLES[table].names)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions present in ``df`` and leaves the others alone.

    ``df`` may read the same partitions: they are replaced when the job commits.
    Rows are spread by the partition columns, so each partition is written by few
    tasks; adaptive execution splits one that is too large for a task.
    """
    spread = df.hint("rebalance", *by)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _typed(df: DataFrame, table: str) -> DataFrame:
    """The table's columns and types; a NULL in a NOT NULL column fails the write."""

    def value(field: T.StructField) -> Column:
        cast = df[field.name].cast(field.dataType)
        if field.nullable:
            return cast.alias(field.name)
        missing = F.raise_error(F.lit(f"{table}.{field.name} is NULL")).cast(field.dataType)
        return F.coalesce(cast, missing).alias(field.name)

    return df.select(*map(value, TABLES[table]))


def write_table(df: DataFrame, root: str, table: str) -> None:
    """Stores rows: the partitions they fall in are replaced, or the whole table if it has none."""
    path, layout = f"{root}/{table}", _layout(table)
    if layout is None:
        _typed(df, table).write.mode("overwrite").parquet(path)
    else:
        column, value = layout
        write_partitioned(_typed(df, table).withColumn(column, value), path, [column])
    df.sparkSession.catalog.refreshByPath(path)


def append_table(df: DataFrame, root: str, table: str) -> None:
    """Adds rows to the partitions they fall in; stored files stay as they are."""
    path, layout = f"{root}/{table}", _layout(table)
    if layout is None:
        _typed(df, table).write.mode("append").parquet(path)
    else:
        column, value = layout
        rows = _typed(df, table).withColumn(column, value).hint("rebalance", column)
        rows.write.mode("append").partitionBy(column).parquet(path)
    df.sparkSession.catalog.refreshByPath(path)


def delete_rows(spark: SparkSession, root: str, table: str, column: str, ids: DataFrame) -> int:
    """Removes the rows whose ``column`` is an ``id`` of ``ids``; returns how many.

    Only partitions that hold such rows are rewritten, and one that has no other rows is
    removed. The ids are joined, whatever their number; what comes to the driver is one row
    per partition. A run that dies in between is completed by running it again.
    """
    stored, (part, _) = _stored(spark, root, table), _layout(table)
    gone = F.col("_gone").isNotNull()
    marked = stored.join(ids.select(F.col("id").alias(column), F.lit(True).alias("_gone")).distinct(), column, "left")
    found = marked.groupBy(part).agg(F.count(F.when(gone, 1)).alias("gone"), F.count(F.when(~gone, 1)).alias("stay"))
    hit = found.where("gone > 0").collect()
    rewritten = [r[part] for r in hit if r.stay]
    if rewritten:
        stay = stored.where(F.col(part).isin(rewritten)).join(ids.select(F.col("id").alias(column)), column, "left_anti")
        write_table(materialize(stay.select(*TABLES[table].names)), root, table)
    for row in hit:
        if not row.stay:
            fs, where = file_system(spark, f"{root}/{table}/{part}={row[part]}")
            fs.delete(where, True)
    spark.catalog.refreshByPath(f"{root}/{table}")
    return sum(r.gone for r in hit)


def create_tables(spark: SparkSession, root: str) -> None:
    """Makes the folders of tables that do not exist yet, with no rows."""
    for table in TABLES:
        empty, layout = spark.createDataFrame([], TABLES[table]), _layout(table)
        writer = empty.write
        if layout is not None:
            column, value = layout
            writer = empty.withColumn(column, value).write.partitionBy(column)
        writer.mode("append").parquet(f"{root}/{table}")
