"""What the page queries write, move and hold: pages are made from small tables built here."""

import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest

from registry import catalogue_queries
from registry.views import Views

DAY = dt.datetime(2024, 1, 1)
TYPES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity decimal(15,2),"
    " l_extendedprice decimal(15,2), l_discount decimal(15,2), l_tax decimal(15,2), l_returnflag string,"
    " l_linestatus string, l_shipdate timestamp",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_type string",
    "supplier": "s_suppkey bigint, s_name string",
}


def line(order, part, supplier, number, flag="A", day=0):
    one = Decimal("1.00")
    return (order, part, supplier, number, one, one * number, one, one, flag, "O", DAY + dt.timedelta(day))


def views(spark, root, lines):
    rows = {
        "lineitem": lines,
        # Order 2 stands twice, order 9 nowhere; part 3 is unknown and supplier 1 stands twice.
        "orders": [(k, (k or 0) % 5, "FOP"[(k or 0) % 3], DAY, "5-LOW") for k in [None, *range(9), 2]],
        "part": [(k, f"part {k}", "TIN") for k in (None, 1, 2)],
        "supplier": [(1, "one"), (1, "one"), (2, "two"), (None, "none")],
    }
    for name, found in rows.items():
        spark.createDataFrame(found, TYPES[name]).write.parquet(f"{root}/{name}.parquet")
    return Views(spark, str(root))


def odd_lines():
    plain = [line(k, 1 + k % 3, 1 + k % 2, n, "ANR"[k % 3], (k * n) % 4) for k in range(10) for n in range(5)]
    return [*plain, line(None, 1, 1, 1), line(1, None, 1, 1), line(1, 1, None, 1), line(2, 1, 1, 1, None), *plain[10:20]]


def test_source_rows_are_those_of_the_sql(spark, tmp_path):
    v = views(spark, tmp_path, odd_lines())
    made, asked = catalogue_queries._source(v), v.sql(catalogue_queries._SOURCE)
    assert made.dtypes == asked.dtypes and made.count() == asked.count() > 40
    assert made.exceptAll(asked).isEmpty() and asked.exceptAll(made).isEmpty()


def test_landed_pages_are_small(spark, tmp_path):
    """Pages repeat their field names: as they lie in the folder they take a fraction of their text."""
    v = views(spark, tmp_path, [line(k % 9, 1, 2, k, "AN"[k % 2]) for k in range(4000)])
    folder = catalogue_queries._landed_pages(v)
    text = sum(len(r.value) + 1 for r in spark.read.text(folder).select("value").collect())
    files = list(Path(folder.removeprefix("file:")).rglob("part-*"))
    assert sum(f.stat().st_size for f in files) < text / 4


@pytest.mark.parametrize("each", [50, 400])
def test_lines_are_numbered_in_bounded_partitions(spark, tmp_path, monkeypatch, each):
    v = views(spark, tmp_path, [line(k % 9, 1, 2, k) for k in range(1200)])
    monkeypatch.setattr(catalogue_queries, "LINES_EACH", each)
    assert catalogue_queries._source(v).rdd.getNumPartitions() >= 1200 // each
