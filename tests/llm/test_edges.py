"""Nulls, empty and long texts, repeats, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from upswell.llm import decontaminate, exact, hosts, mixing, quality, repeats, sharding, simhash, templates, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "alpha beta gamma delta. " * 20_000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one two three", "en", "a", 13),
    (4, "one two three", "en", "b", 13),
    (4, "one two three", "en", "b", 13),
    (5, LONG, "en", None, len(LONG)),
    (None, "no id at all", "en", "b", 12),
    (7, "Größe ñandú 漢字 😀 " * 10, "xx", "c", 1),
]
#: Names that an operator might use inside.
CLASHING = ["kept", "_id", "_key", "_gone", "count", "size", "fp", "shard", "slot", "_bucket", "n_words", "tail", "_n"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    return docs.withColumns({c: F.lit("mine") for c in CLASHING})


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


OPERATORS = {
    "templates": lambda d: templates.drop_recurring_lines(d),
    "repeats": lambda d: repeats.repeated_spans(d),
    "exact_groups": lambda d: exact.exact_groups(d),
    "drop_copies": lambda d: exact.drop_copies(d),
    "scan": lambda d: decontaminate.scan(d, d.selectExpr("doc_id as item_id", "text")),
    "near_groups": lambda d: simhash.near_groups(d),
    "keep_first": lambda d: simhash.keep_first(d),
    "keep_good": lambda d: quality.keep_good(d, d.selectExpr("doc_id", "1 as quality", "0 as toxic")),
    "mix": lambda d: mixing.mix(d),
    "take": lambda d: mixing.take(d),
    "shards": lambda d: sharding.shuffled_shards(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_clashing_columns(docs, empty, name):
    run = OPERATORS[name]
    assert run(empty).collect() == []
    plain, other = run(docs), run(clashing(docs))
    common = [c for c in plain.columns if c not in CLASHING]
    flat = [F.col(c).cast("string") for c in common]
    assert sorted(map(str, plain.select(*flat).collect())) == sorted(map(str, other.select(*flat).collect()))


def test_templates(spark, docs):
    assert {r.n_dropped for r in templates.drop_recurring_lines(docs).collect()} == {0}
    lines = [(i, f"own words of {'abcdefgh'[i]} only\nPage {i} of 9 printed at noon\n\nend {'abcdefgh'[i]}", "en", "s", 0) for i in range(6)]
    lines += [(6, None, None, None, None), (7, "", None, None, None)]
    found = {r.doc_id: r for r in templates.drop_recurring_lines(spark.createDataFrame(lines, DOCS)).collect()}
    for i in range(6):
        assert found[i].text == f"own words of {'abcdefgh'[i]} only\n\nend {'abcdefgh'[i]}" or "own words" not in found[i].text
        assert "Page" not in found[i].text and found[i].n_lines == 4
    assert found[6].text is None and found[6].n_lines == 0 and (found[7].text, found[7].n_lines) == ("", 1)
    # Lines of numbers go where they stand unchanged in five texts, and only there.
    notes = ["Tel. 555-0100 Fax 555-0101 90210", "Copyright 2020 2021 2022"]
    dialled = [(i, f"own {'abcdefgh'[i]} words\n{notes[0]}\n{notes[1]}\nCopyright 20{i}0 20{i}1 20{i}2 {i}" if i < 6 else notes[0], "en", "s", 0) for i in range(7)]
    cut = {r.doc_id: r.text for r in templates.drop_recurring_lines(spark.createDataFrame(dialled, DOCS)).collect()}
    assert all("Tel." not in cut[i] and notes[1] not in cut[i].split("\n") and f"20{i}0" in cut[i] for i in range(6)) and cut[6] == ""
    # Copies of one text count once: nothing recurs.
    copies = spark.createDataFrame([(i, "Page 1 of 9 printed at noon", "en", "s", 0) for i in range(9)], DOCS)
    assert {r.n_dropped for r in templates.drop_recurring_lines(copies).collect()} == {0}


def test_exact(docs):
    found = {(r.doc_id, r.text_sha256): r for r in exact.exact_groups(docs).collect()}
    assert len(found) == 7 and exact.exact_groups(docs).count() == len(ROWS)
    three = hashlib.sha256(b"one two three").hexdigest()
    assert (found[3, three].keep_id, found[3, three].group_size, found[3, three].kept) == (4, 3, False)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[1, nothing].keep_id == 2 and found[2, nothing].kept and found[4, three].kept
    left = [r.doc_id for r in exact.drop_copies(docs).collect()]
    assert sorted(left, key=str) == [2, 4, 4, 5, 7, None]


def test_exact_survives_a_clash_of_identifiers(spark, docs, monkeypatch):
    plain = rows(exact.exact_groups(docs), "doc_id", "text_sha256")
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.length(c[0]).cast("bigint") * 0)
    assert rows(exact.exact_groups(docs), "doc_id", "text_sha256") == plain


def test_chunks_add_up(docs):
    text = F.coalesce("text", F.lit(""))
    joined = F.array_join(exact.chunks(text, 16, 64), "")
    assert docs.where(joined != text).count() == 0
    assert docs.where(F.exists(exact.chunks(text, 16, 64), lambda c: F.length(c) > 64)).count() == 0


def test_simhash(docs):
    found = {(r.doc_id): r for r in simhash.near_groups(docs).collect()}
    assert simhash.near_groups(docs).count() == len(ROWS)
    assert found[1].fp == 0 and found[1].component_id == 1 and found[2].component_id == 1
    assert found[3].fp == found[4].fp and found[4].component_id == 3
    assert sorted(str(r.doc_id) for r in simhash.keep_first(docs).collect()) == ["1", "3", "5", "7", "None"]


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "ONE, two!"), (3, "ONE, two!"), (4, "漢字")], "item_id bigint, text string")
    found = {(r.doc_id, r.text): r for r in decontaminate.scan(docs, bench).collect()}
    hit = found[3, "one two three"]
    assert (hit.n_words, hit.n_hit, hit.n_items, hit["items"], hit.spans) == (3, 2, 1, ["3"], [[0, 7]])
    assert found[1, None].n_words == 0 and found[2, ""].n_hit == 0
    wide = found[7, ROWS[7][1]]
    assert wide.n_hit == 10 and all(ROWS[7][1][a:b] == "漢字" for a, b in wide.spans)
    # Several automata give what one gives.
    parts = decontaminate.scan(docs, bench, block_bytes=8)
    assert sorted(map(str, parts.collect())) == sorted(map(str, decontaminate.scan(docs, bench).collect()))
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_mix(spark, docs):
    found = mixing.mix(docs).collect()
    assert len(found) == len(ROWS) and all(r.taken <= 2 * r.size for r in found)
    by_source = {}
    for r in found:
        by_source.setdefault(r.target, []).append(r)
    total = sum(r.size for r in found)
    assert sum(r.taken for r in found) <= 1.5 * total
    assert sum(r.size for r in found if r.doc_id == 4) == 6 and {r.source_size for r in found if r.doc_id == 4} == {10}
    assert rows(mixing.mix(docs.repartition(7)), "doc_key", "copies") == rows(mixing.mix(docs), "doc_key", "copies")
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in found if r.size)


def test_mix_near_targets(spark):
    some = spark.range(3000).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 17 as int)) as text",
        "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 5) end as source",
    )
    found = mixing.mix(some).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most"))
    for r in found.collect():
        assert abs(r.taken - r.target) <= 2 * r.most and r.target <= 2 * r.source_size


def test_shards(spark, docs):
    some = spark.range(1000).selectExpr("case when id < 400 then 7 when id < 450 then null else id end as doc_id", "concat('t', id) as text")
    found = sharding.shuffled_shards(some, bucket_bytes=2000).collect()
    assert sorted(r.text for r in found) == sorted(f"t{i}" for i in range(1000))
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r.text for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    again = sharding.shuffled_shards(some.repartition(9), bucket_bytes=2000).collect()
    assert [r.text for r in sorted(again, key=lambda r: (r.shard, r.slot))] == order
    other = sharding.shuffled_shards(some, bucket_bytes=2000, seed=1).collect()
    assert [r.text for r in sorted(other, key=lambda r: (r.shard, r.slot))] != order
    assert sharding.shuffled_shards(docs).count() == len(ROWS)


def test_hot_doc_id_is_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 50)
    some = spark.range(2000).selectExpr("cast(1 as bigint) as doc_id", "concat('t', id) as text")
    found = sharding.shuffled_shards(some, bucket_bytes=1000)
    assert found.select("text").distinct().count() == 2000
    assert found.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2]


PAGES = "page_id bigint, url string, html string"


def test_hosts(spark):
    urls = [
        None, "", "no scheme", "http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://a.www.example.com/en/y",
        "http://notexample.com/en/", "http://x.net/fr/1", "http://x.net/frx", "http://com/", "http://h:80/p", "a://b://c/d", "http://x.com?y",
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(0, None, None)], PAGES)
    none = spark.createDataFrame([], "page_id bigint, good boolean")
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge_urls(pages, none, rules).collect()}
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("example.com", "/en/x", "example.com/en/", "block")
    assert found[4][2:] == found[5][2:] == ("www.example.com/en/", "allow")
    assert found[6] == ("notexample.com", "/en/", "com/", "allow")
    assert found[7] == ("x.net", "/fr/1", "net/fr/", "block") and found[8][2] is None
    assert found[9][2] == "com/" and found[10] == ("h:80", "/p", None, "allow")
    assert found[11][:2] == ("b:", "//c/d") and found[12] == ("x.com", "", None, "allow")
    assert hosts.judge_urls(pages.limit(0), none, rules).collect() == []
    assert hosts.judge_urls(pages, none).count() == len(urls) + 1


def test_reputation_shrinks(spark):
    hosts_of = ["bad.spam.org"] * 40 + ["new.spam.org"] + ["good.fine.org"] * 40 + ["rare.other.org"]
    good = [False] * 40 + [None] + [True] * 40 + [False]
    found = {r.host: r for r in hosts.reputations(spark.createDataFrame(list(zip(hosts_of, good)), "host string, good boolean")).collect()}
    assert found["bad.spam.org"].high < 0.5 < found["good.fine.org"].low
    # A host nobody labelled follows its domain; one bad page proves little.
    assert found["new.spam.org"].mean < 0.5 and found["rare.other.org"].high > found["bad.spam.org"].high


def test_domains(spark):
    names = ["www.a.co.uk", "a.b.example.com", "example.com", "localhost", "10.0.0.1:80", "", "x.org.br"]
    frame = spark.createDataFrame([(n,) for n in names], "h string")
    found = [tuple(r) for r in frame.select(hosts.domain_of(F.col("h")), hosts.suffix_of(F.col("h"))).collect()]
    assert found == [
        ("a.co.uk", "co.uk"), ("example.com", "com"), ("example.com", "com"), ("localhost", "localhost"), ("10.0.0.1", ""), ("", ""), ("x.org.br", "org.br"),
    ]


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n" + "ñ" * 50
    pages = spark.createDataFrame(
        [(1, "http://a/", big), (2, "http://b/ c", big), (3, None, None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (None, "u", big), (2, "http://b/ c", big)],
        PAGES,
    ).withColumns({"count": F.lit(1), "record_type": F.lit("mine"), "_key": F.lit(1)})
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write_archives(pages, path, compression=compression)
        records = warc.read_archives(spark, path)
        found = {r.page_id: r for r in warc.resolved(records).collect()}
        digest = hashlib.sha256(big.encode()).hexdigest()
        assert len(found) == 7 and records.count() == 8 and warc.resolved(records).count() == 8
        assert records.select("record_id").distinct().count() == 8
        assert (found[2].record_type, found[2].refers_to, found[2].payload_digest) == ("revisit", 1, digest)
        assert found[2].payload_bytes == found[1].payload_bytes == len(big.encode()) and found[None].refers_to == 1
        assert {found[i].record_type for i in (1, 3, 4, 5, 6)} == {"response"} and found[3].payload_bytes == 0
        assert {r.page_id: r.payload for r in records.collect()}[1] == big
    warc.write_archives(pages.limit(0), str(tmp_path / "none at all"))
    assert warc.read_archives(spark, str(tmp_path / "none at all")).collect() == []


def test_warc_keeps_every_row(spark, tmp_path, monkeypatch):
    """One page under two urls, rows without an id, and one row a great many times."""
    monkeypatch.setattr(warc, "HOT_ROWS", 20)
    big = "<p>" + "x" * 200
    rows = [(1, "http://a/", big), (1, "http://b/", big), (None, "u", big), (None, "v", big), (2, "w", big)] + [(2, "hot", big)] * 150 + [(3, "own", "y" * 150)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    warc.write_archives(pages, str(tmp_path / "out"), file_bytes=4000)
    records = warc.read_archives(spark, str(tmp_path / "out")).cache()
    assert sorted(map(str, ((r.page_id, r.url) for r in records.collect()))) == sorted(map(str, ((i, u) for i, u, _ in rows)))
    assert records.select("record_id").distinct().count() == len(rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in records.collect()}
    assert kinds == {(1, "response", None), (3, "response", None), (2, "revisit", 1), (None, "revisit", 1)}
    assert {r.payload_bytes for r in warc.resolved(records).where("record_type = 'revisit'").collect()} == {203}
    assert warc.resolved(records).count() == len(rows)
    files = spark.read.format("binaryFile").load(str(tmp_path / "out")).count()
    assert files > 4


def test_warc_notices_a_wrong_payload():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 5\r\n\r\n"
    with pytest.raises(ValueError, match="differ"):
        list(warc.parse(memoryview((head + "\r\n\r\na\r\n\r\n").encode())))


def test_keep_first_tells_rows_by_id_and_text(spark):
    near, clean, other = "a text that several rows have", "something else entirely here", "words of a third kind only"
    some = [
        (1, near, "en", "a", 0), (None, near, "en", "a", 0), (None, clean, "en", "a", 0),  # a unique text without id stays
        (2, near, "en", "a", 0), (2, other, "en", "a", 0),  # of two texts under one id, only the copy goes
        (5, "copies under one id", "en", "b", 2), (5, "copies under one id", "en", "a", 1), (5, "Copies under one id", "en", "c", 3),
        (None, "nobody has an id", "en", "a", 0), (None, "nobody has an id", "en", "a", 0), (None, "Nobody has an id", "en", "a", 0),
    ]
    frame = spark.createDataFrame(some, DOCS)
    kept = [(r.doc_id, (r.text or "").lower()) for r in simhash.keep_first(frame).collect()]
    expected = [(1, near), (2, other), (5, "copies under one id"), (None, clean), (None, "nobody has an id")]
    assert sorted(kept, key=str) == sorted(expected, key=str)
    assert simhash.keep_first(frame).columns == frame.columns
    again = simhash.keep_first(frame.orderBy(F.desc("n_chars")).repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, simhash.keep_first(frame).collect()))


def test_training_counts_a_repeated_id_once(spark):
    docs = spark.range(12).selectExpr("id as doc_id", "concat('word', id % 3, ' text ', id) as text")
    grades = spark.range(12).selectExpr("id as doc_id", "cast(id % 3 as int) as grade")
    hot = docs.where("doc_id = 1").crossJoin(spark.range(300).select()).union(docs.where("doc_id <> 1"))
    assert hot.count() == 311
    once, many = quality.train(docs, grades), quality.train(hot, grades)
    assert (once.weights == many.weights).all() and (once.thresholds == many.thresholds).all()
