"""Pages from a caller's function: a Spark data source with one partition per page.

The function gets (start, size) and returns the page's JSON text as a service sends it. It is
called in tasks, so it has to be picklable; how it reaches its service is its own affair.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from upswell.fixed_values import MAX_PAGES, PAGE_SIZE

#: (start, size) to the text of a page; None if there is no such page.
Fetch = Callable[[int, int], "str | None"]
_ROW = "page bigint, value string"


@dataclass
class _Page(InputPartition):
    start: int
    text: str | None = None


def _page(fetch: Fetch, start: int, size: int) -> str:
    text = fetch(start, size)
    if text is None:
        raise ValueError(f"the page from {start} is missing")
    return text


def paged_source(
    name: str, fetch: Fetch, items: str = "items", total: str = "totalCount", size: int = PAGE_SIZE, max_pages: int = MAX_PAGES
) -> type[DataSource]:
    """A data source to register: ``page, value`` of every page up to the announced ``total``.

    The first page is read to learn the total, and travels on with its partition; each other
    page is fetched by its own task, repeated if the executor is lost. A service that
    announces no total gives its first page only. As a stream, the offset is the number of
    items read: each micro-batch takes the page that starts there, if it has any.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[_Page]:
            first = _page(fetch, 0, size)
            pages = min(max_pages, max(1, -(-int(json.loads(first).get(total) or 0) // size)))
            return [_Page(0, first), *(_Page(nth * size) for nth in range(1, pages))]

        def read(self, partition: _Page) -> Iterator[tuple[int, str]]:
            yield partition.start, partition.text or _page(fetch, partition.start, size)

    class StreamReader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"start": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
            text = fetch(start["start"], size)
            found = len(json.loads(text).get(items) or []) if text else 0
            rows = [(start["start"], text)] if found else []
            return iter(rows), {"start": start["start"] + found}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
            if end["start"] > start["start"]:
                # As many items as the first reading had, also where there are more by now.
                yield start["start"], _page(fetch, start["start"], end["start"] - start["start"])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return _ROW

        def reader(self, schema: T.StructType) -> Reader:
            return Reader()

        def simpleStreamReader(self, schema: T.StructType) -> StreamReader:
            return StreamReader()

    return Source


def parsed(pages: DataFrame, schema: T.StructType) -> DataFrame:
    """The pages as documents of ``schema``, numbered by where they start; a broken one fails the read."""
    document = pages.select("page", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"))
    return document.select("page", *[F.col(f"d.{n}").alias(n) for n in schema.names if n != "page"])


def read_paged(spark: SparkSession, fetch: Fetch, schema: T.StructType, name: str = "pages", **how) -> DataFrame:
    """All pages of ``fetch`` as documents, in the form that ``landed`` takes them."""
    spark.dataSource.register(paged_source(name, fetch, **how))
    return parsed(spark.read.format(name).load(), schema)
