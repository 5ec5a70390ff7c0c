"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import set_aside
from upswell.llm.components import components
from upswell.session import materialize

SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: A segment value shared by more fingerprints than this is searched by midpoints.
CROWD = 64


def fingerprint(text: bytes, size: int) -> int:
    """The 64-bit SimHash of a text, as a signed integer: majority bits of its shingles' hashes."""
    words = text.lower().split()
    if len(words) < size:
        return np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64) if words else 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in shingles)
    ones, total = np.zeros(64, np.int64), 0
    while block := list(islice(hashes, BLOCK)):
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    return np.packbits(2 * ones > total, bitorder="little").view("<i8")[0]


def fingerprints(docs: DataFrame, size: int = 3, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, over its whole text; NULL and no words give 0.

    ``keyed`` adds text_key, a digest of the text, in the same pass.
    """
    names = ["doc_id", "fp", *(["text_key"] if keyed else [])]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", size) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    key = [_text_key().alias("text_key")] if keyed else []
    read = docs.select("doc_id", "text", *key)
    return read.mapInArrow(hashed, f"doc_id {kind}, fp bigint" + (", text_key binary" if keyed else ""))


def _text_key() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _segments(fp: Column) -> list[Column]:
    """The two halves of a fingerprint."""
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))]


def _ball(value: Column, bits: int) -> Column:
    """The values at Hamming distance 0 and 1."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(bits)])


def links(prints: DataFrame, most_bits: int = 2) -> DataFrame:
    """(u, v): pairs of different fingerprints whose links span all pairs within ``most_bits``.

    Multi-index hashing over a table of distinct ``fp``. Of two fingerprints at distance 2
    or less, one half differs by one bit at most. So every fingerprint asks the table of
    each half for the 33 values around its own, and the complete distance is verified.

    A half shared by more than ``CROWD`` fingerprints would give all pairs in the crowd.
    Crowded fingerprints meet other crowded ones in midpoints instead: two of them are
    within 2 bits if and only if some value is within 1 bit of both, so each is linked to
    the smallest one around every value of its ball of 65: as connected, and linear.
    """
    if not 0 <= most_bits <= 2:
        raise ValueError("halves with balls of one bit find distances up to 2")
    halves = F.array(*[F.struct(F.lit(i).alias("half"), s.alias("key")) for i, s in enumerate(_segments(F.col("fp")))])
    table = materialize(prints.select("fp", F.explode(halves).alias("s")).select("fp", "s.half", "s.key"))
    crowds = materialize(table.groupBy("half", "key").count().where(F.col("count") > CROWD).drop("count"))
    crowded = table.join(crowds, ["half", "key"], "left_semi").select("fp").distinct()
    probes = table.select(F.col("fp").alias("u"), "half", F.explode(_ball(F.col("key"), 32)).alias("key"))
    entries = table.join(crowds, ["half", "key"], "left_anti").withColumnRenamed("fp", "v")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most_bits
    pairs = probes.join(entries, ["half", "key"]).where((F.col("u") != F.col("v")) & close)
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if most_bits < 2:  # midpoints stand for distance 2; distance 0 links nothing
        return pairs.unionByName(_neighbours(crowded)) if most_bits else pairs
    around = materialize(crowded.select("fp", F.explode(_ball(F.col("fp"), 64)).alias("middle")))
    least = around.groupBy("middle").agg(F.min("fp").alias("v"))
    stars = around.join(least, "middle").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars)


def _neighbours(crowded: DataFrame) -> DataFrame:
    """Pairs of crowded fingerprints that differ in one bit: 65 questions each."""
    around = crowded.select(F.col("fp").alias("u"), F.explode(_ball(F.col("fp"), 64)).alias("v"))
    found = around.join(crowded.select(F.col("fp").alias("v")), "v").where("u > v")
    return found.select("u", "v")


def _rooted(marked: DataFrame, most_bits: int) -> DataFrame:
    """(fp, first, root): the smallest doc_id of every fingerprint, and its component."""
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = materialize(components(links(prints.select("fp"), most_bits)))
    return prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_groups(docs: DataFrame, size: int = 3, most_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents joined through fingerprints within ``most_bits``.

    Equal fingerprints are folded to one before any search. component_id is the smallest
    doc_id that a document reaches through links, itself included.

    NULL and wordless texts have fingerprint 0, linked like any other. Every row of
    ``docs`` gives one row, repeated ones too. A NULL doc_id is larger than any other.
    Other columns are not read. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, size))
    rooted = _rooted(marked, most_bits)
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    component = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(component, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = 3, most_bits: int = 2) -> DataFrame:
    """One row of ``docs``, all columns, of each component: the first by doc_id and text digest.

    A NULL doc_id is larger than any other. Rows are told apart by doc_id and text, so a
    doc_id may stand on several texts, and NULL on any. Of rows that repeat both, the one
    with the least digest of all columns stays.
    """
    marked = materialize(fingerprints(docs, size, keyed=True))
    # Copies are folded first; written before the join, so that a large component can be split.
    texts = materialize(marked.groupBy("fp", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")))
    placed = materialize(texts.join(_rooted(marked, most_bits).select("fp", "root"), "fp").drop("fp"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    firsts = materialize(placed.groupBy("root").agg(F.min(order).alias("first")))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    judged = placed.join(firsts, "root").select(
        F.col("doc_id").alias("_gone"), F.col("text_key").alias("_text"), "n", is_first.alias("first")
    )
    other = materialize(judged.where(~F.col("first") | (F.col("n") > 1)))
    aside, back = set_aside(docs, ["_gone", "_text", "_row"])
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (_text_key() == F.col("_text"))
    left = aside.join(other.select("_gone", "_text"), same, "left_anti")
    left = left.select(*back(left))
    repeated = other.where("first").select("_gone", "_text")
    if repeated.isEmpty():
        return left
    rows = aside.join(repeated, same)
    digest = F.sha2(F.to_json(F.struct(*aside.columns)), 256)
    one = rows.groupBy("_gone", "_text").agg(F.min_by(F.struct(*aside.columns), digest).alias("_row"))
    one = one.select("_row.*")
    return left.union(one.select(*back(one)))
