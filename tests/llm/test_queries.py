"""The registered queries against their SQL on a small table."""

import __spark_entry__ as entry
import check
import pytest
from upswell.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) < set(queries.QUERIES)
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert check.compare(spark, SF, queries.QUERIES[name], queries.ORACLES[name]) == ""


REPEATED = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "a b c", "s"), (2, "d", None), (2, "d", None), (3, "e f", "t")]


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op9_mix_sources", "op11_merkle_manifest"])
def test_repeated_rows_against_sql(spark, tmp_path, name):
    """Rows that repeat others in every column count and come back, in the query as in its SQL."""
    if name not in queries.ORACLES:
        pytest.skip("no SQL")
    rows = [(i, t, "en", s, len(t)) for i, t, s in REPEATED]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    for table in check.TABLES:
        if table != "documents":
            (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    (part,) = (tmp_path / "parts").glob("*.parquet")
    (tmp_path / "documents.parquet").symlink_to(part)
    assert check.compare(spark, str(tmp_path), queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_repeated_pages_against_sql(spark, tmp_path):
    big = "x" * 200
    pages = spark.createDataFrame([(1, "a", big), (1, "b", big), (2, "c", big), (2, "c", big), (3, "d", "t")], "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "parts"))
    for table in check.TABLES:
        if table != "pages":
            (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    (part,) = (tmp_path / "parts").glob("*.parquet")
    (tmp_path / "pages.parquet").symlink_to(part)
    assert check.compare(spark, str(tmp_path), queries.QUERIES["op6_warc_revisits"], queries.ORACLES["op6_warc_revisits"]) == ""
