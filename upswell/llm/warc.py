"""Web archives: writing records, reading them back, and revisit records for repeated payloads."""

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.llm.common import null_last, partitions_for, shuffle_width
from upswell.session import materialize

CRLF = "\r\n"
#: Between the header of a record and its block, and after each record.
GAP = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A reader takes a file whole, so a file gets about this much.
FILE_BYTES = 32 << 20
#: Rows that repeat a page and its payload more often than this are dealt over files.
HOT_ROWS = 1000
#: Rows leave the reader in batches of about this many payload bytes.
BATCH_BYTES = 4 << 20

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, copies), written once: every row of ``pages`` counts.

    Of the payloads only their digests move, and rows that repeat all of these are folded
    in the map tasks.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    found = pages.select(
        "page_id",
        "url",
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html, 256).alias("payload_digest"),
    )
    return materialize(found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("copies")))


def resolve(found: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Adds record_type, refers_to and refers_url to the rows of ``headers``.

    Headers are shuffled by payload digest: the smallest page_id of a digest is the
    response, the others revisit it. Payloads under ``least_bytes`` are all responses, and
    so are all rows of that smallest page_id; a revisit names the first of them by url.
    Digests fold in the map tasks, and a frequent one is split over tasks in the join.
    """
    # Written before the join, so that adaptive execution can split a frequent payload there.
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))))
    first = materialize(
        found.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(first.alias("_first"))
    )
    revisits = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    return found.join(first, "payload_digest", "left").select(
        *found.columns,
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisits, F.col("_first.page_id")).alias("refers_to"),
        F.when(revisits, F.col("_first.url")).alias("refers_url"),
    )


def _record_key(digest: str) -> Column:
    """One value for a page and its payload; a NULL page_id counts as a value."""
    return F.md5(F.concat_ws(":", null_last(F.col("page_id")), F.col(digest)))


def record_id(page_id: Column, digest: Column, url: Column, nth: Column) -> Column:
    """A UUID made of the page, its payload, its url and the number of the copy: the same for the same record."""
    h = F.md5(F.concat_ws(":", page_id.cast("string"), digest, nth.cast("string"), url))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def record_text(date: str) -> Column:
    """One record without the gap after it: fresh headers, then the block.

    A response has its payload; a revisit has only the HTTP headers.
    """

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    is_revisit = F.col("record_type") == "revisit"
    payload = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF),
        F.lit("Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(GAP),
    )
    length = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.octet_length(payload))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    refers = F.when(
        is_revisit,
        F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line(
                "WARC-Refers-To",
                F.concat(F.lit("<"), record_id(F.col("refers_to"), F.col("payload_digest"), F.col("refers_url"), F.lit(1)), F.lit(">")),
            ),
            line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        ),
    ).otherwise(F.lit(""))
    page = F.when(
        F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line(
            "WARC-Record-ID",
            F.concat(F.lit("<"), record_id(F.col("page_id"), F.col("payload_digest"), F.coalesce("url", F.lit("")), F.col("nth")), F.lit(">")),
        ),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        page,
        refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
        F.when(is_revisit, F.lit("")).otherwise(payload),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = 100,
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
    compression: str = "gzip",
) -> None:
    """Writes one record per page below ``path``: responses, and revisits of equal payloads.

    Headers are shuffled by digest, payloads once by page, into files of about
    ``file_bytes`` before compression. Spark's text writer commits files when a job ends, so a lost executor
    leaves no half file behind; its line separator is what closes every record.

    NULL html is an empty payload, a NULL url an empty one. Every row gives a record, also
    one that repeats another in all columns; of a page and payload that over ``HOT_ROWS``
    rows repeat, the payload is taken once and the records are dealt over files. A payload
    may be longer than ``file_bytes``: its file then is as long. Other columns are not
    written. An empty table gives no records.
    """
    found = headers(pages)
    total = found.agg(F.sum(F.col("copies") * (F.col("payload_bytes") + 600))).first()[0]
    files = partitions_for(total, file_bytes, shuffle_width(pages))
    keyed = found.withColumn("_key", _record_key("payload_digest"))
    hot = materialize(
        keyed.groupBy("_key").agg(F.sum("copies").alias("_all")).where(F.col("_all") > HOT_ROWS).select(
            "_key", F.ceil(F.col("_all") / HOT_ROWS).alias("_parts")
        )
    )
    records = resolve(found, least_bytes).withColumn("_key", _record_key("payload_digest"))
    records = records.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    payloads = pages.select("page_id", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("_digest")).select(
        _record_key("_digest").alias("_key"), "html"
    )
    if not hot.isEmpty():
        # A hot key gets the number of a part; the others stay as they are.
        deal = lambda part: F.concat("_key", F.lit(":"), part.cast("string"))
        part = deal(F.pmod(F.xxhash64("url", "nth"), F.col("_parts")))
        records = records.join(hot, "_key", "left").withColumn("_key", F.coalesce(part, "_key")).drop("_parts")
        # Folded in the map tasks: one payload per key and task moves.
        once = payloads.join(hot, "_key", "left_semi").groupBy("_key").agg(F.first("html").alias("html")).join(hot, "_key")
        once = once.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        payloads = payloads.join(hot, "_key", "left_anti").unionByName(once.select(deal(F.col("_part")).alias("_key"), "html"))
    # Both sides are dealt by the one join key, so payloads move once.
    single = payloads.repartition(files, "_key").dropDuplicates(["_key"])
    joined = single.join(records.repartition(files, "_key"), "_key")
    texts = joined.select(record_text(date).alias("value"))
    texts.write.option("lineSep", GAP).text(path, compression=compression)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, as in ``RECORD``; revisits unresolved.

    Files come through Spark, so any store it reads will do. Records are found by their
    lengths, so a payload may hold any text.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_records, RECORD)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            pa.field(n, pa.int64() if n in ("page_id", "refers_to", "payload_bytes") else pa.string())
            for n in RECORD.names
        ]
    )
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for row in parse(memoryview(content.as_buffer())):
                rows.append(row)
                held += row["payload_bytes"]
                if held > BATCH_BYTES or len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def parse(data: memoryview) -> Iterator[dict]:
    """Every record of one archive, gzipped or not. A payload unlike its digest is an error."""
    raw, at = gzip.decompress(data) if bytes(data[:2]) == b"\x1f\x8b" else bytes(data), 0
    gap = GAP.encode()
    while at < len(raw):
        end = raw.index(gap, at)
        lines = raw[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + len(gap)
        stop = start + int(head["content-length"])
        block = raw[start:stop]
        payload = block[block.index(gap) + len(gap) :]
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        revisit = head["warc-type"] == "revisit"
        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload and digest differ in the record at byte {at}")
        yield {
            "record_id": head["warc-record-id"].strip("<>"),
            "record_type": head["warc-type"],
            "page_id": _number(head.get("x-page-id")),
            "url": head["warc-target-uri"],
            "payload_digest": digest,
            "refers_to": _number(head.get("x-refers-to-page")),
            "payload_bytes": len(payload),
            "payload": None if revisit else payload.decode(),
        }
        at = stop + len(gap)


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def resolved(records: DataFrame) -> DataFrame:
    """The rows of ``read_archives`` with the full payload's length in every revisit.

    Only headers are joined: the original responses' digests and lengths to the revisits
    that name them. A revisit whose original is missing has a NULL length.
    """
    plain = materialize(
        records.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
    responses = plain.where("record_type = 'response'")
    revisits = plain.where("record_type = 'revisit'")
    originals = responses.select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_full")
    ).distinct()
    return responses.unionByName(
        revisits.join(originals, ["refers_to", "payload_digest"], "left").select(
            "page_id",
            "url",
            F.col("_full").alias("payload_bytes"),
            "payload_digest",
            "record_type",
            "refers_to",
        )
    )
