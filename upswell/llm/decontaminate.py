"""Benchmark decontamination with an Aho-Corasick automaton over windows of words."""

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.llm.common import set_aside
from upswell.session import materialize

#: Words of an unfolded text: ASCII digits and letters and all characters beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Byte by byte: A-Z folded, ASCII characters of no word to spaces, the rest as it is.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: One automaton holds at most this many bytes of windows. It takes some 40 bytes of memory
#: for each: a full block of distinct words took 380 MB.
BLOCK_BYTES = 8 << 20


def normalised(text: str | None) -> list[bytes]:
    """The words of a text, A-Z folded, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows(words: list[bytes], width: int) -> set[bytes]:
    """Every run of ``width`` words; all of them if there are fewer, none of none."""
    if not words:
        return set()
    last = max(1, len(words) - width + 1)
    return {b" ".join(words[i : i + width]) for i in range(last)}


def window_table(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, items): the distinct windows of all items, each with the ids it comes from."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
                found = list(windows(normalised(text), width))
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    columns = [pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["item_id", "window"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    each = items.mapInArrow(cut, "item_id string, window binary").where(F.col("item_id").isNotNull())
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def automaton(found: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    """One automaton over (window, items); a match gives (number of words, items).

    Windows stand between spaces, so only whole words match. Bytes go in as Latin-1, one
    character each.
    """
    machine = ahocorasick.Automaton()
    for window, items in found:
        machine.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
    if found:
        machine.make_automaton()
    return machine


def blocks(benchmark: DataFrame, width: int, block_bytes: int) -> tuple[int, Iterator[list[tuple[bytes, list[str]]]]]:
    """How many blocks the windows of the benchmark need, and the blocks, one at a time.

    Windows are dealt by their hash, so one long item may lie in many blocks, and a block
    has about ``block_bytes`` of windows.
    """
    table = materialize(window_table(benchmark, width))
    total = table.agg(F.sum(F.octet_length("window") + F.size("items"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    own = lambda nth: table.where(F.pmod(F.xxhash64("window"), F.lit(count)) == nth).collect()
    return count, ([(bytes(r["window"]), list(r["items"])) for r in own(nth)] for nth in range(count))


_ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)
_KINDS = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))]


def scan(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items and spans; every text is scanned once.

    n_hit counts the words inside any occurrence of a window of ``width`` benchmark words,
    n_items the items that a found window belongs to; items has their ids as sorted
    strings. spans has the occurrences joined where they touch, as [start, end) in
    characters of the original text.

    The rows stay where they are: no shuffle. Every task builds one automaton, of at most
    ``block_bytes`` of windows. A benchmark with more takes several passes, one automaton
    each: a pass writes the hits of the texts that have any, and the texts then meet their
    hits of all passes by a digest of the text.

    NULL and empty texts have no words, and benchmark items without words no windows; an
    item without an id has none either. An item_id that repeats counts once. Texts of any
    length are scanned whole; a task holds one of them and its matches at a time. Rows of
    ``docs`` that repeat are scanned each. All columns stay; n_words, n_hit, n_items, items
    and spans replace columns of these names. An empty table gives no rows, an empty
    benchmark no hits.
    """
    kept, back = set_aside(docs.drop(*_ADDED.names), ["_key", "_found"])
    count, parts = blocks(benchmark, width, block_bytes)
    if count == 1:
        found = kept.mapInArrow(_scanner(next(parts)), T.StructType([*kept.schema.fields, *_ADDED.fields]))
        return found.select(*back(found), *_ADDED.names)
    hits = None
    for part in parts:
        shape = "_key string, hit binary, items array<string>"
        one = materialize(kept.select("text").mapInArrow(_finder(part), shape))
        hits = one if hits is None else hits.unionByName(one)
    # Copies have the same hits; of one text there is a row per pass at most.
    once = hits.dropDuplicates(["_key", "hit", "items"]).groupBy("_key")
    united = materialize(once.agg(F.collect_list(F.struct("hit", "items")).alias("_found")))
    keyed = kept.withColumn("_key", F.md5(F.coalesce("text", F.lit(""))))
    met = keyed.join(united, "_key", "left").select(*kept.columns, "_found")
    found = met.mapInArrow(_joiner, T.StructType([*kept.schema.fields, *_ADDED.fields]))
    return found.select(*back(found), *_ADDED.names)


def _extended(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != "_found"]
    arrays = [batch.column(n) for n in names]
    arrays += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)]
    return pa.RecordBatch.from_arrays(arrays, [*names, *_ADDED.names])


def _scanner(part: list[tuple[bytes, list[str]]]) -> Callable:
    def scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(part)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = normalised(text.as_py())
                rows.append(_summary(text.as_py(), len(words), *_hits(machine, words)))
            yield _extended(batch, rows)

    return scanner


def _finder(part: list[tuple[bytes, list[str]]]) -> Callable:
    """The texts with a hit, by digest: which of their words are hit, as one byte each, and the items."""

    def finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(part)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                hit, items = _hits(machine, normalised(text.as_py()))
                if hit is not None:
                    key = hashlib.md5(text.as_py().encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((key, hit.tobytes(), sorted(items)))
            kinds = (pa.string(), pa.binary(), pa.list_(pa.string()))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "hit", "items"])

    return finder


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The added columns from the hits of all passes."""
    for batch in batches:
        rows = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("_found").to_pylist(), strict=True):
            hit, items = None, set()
            for one in found or []:
                mine = np.frombuffer(one["hit"], bool)
                hit = mine if hit is None else hit | mine
                items.update(one["items"])
            rows.append(_summary(text, len(normalised(text)), hit, items))
        yield _extended(batch, rows)


def _hits(machine: ahocorasick.Automaton, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
    """Which words are inside an occurrence (None: no word is), and the items of the windows met."""
    line = f" {b' '.join(words).decode('latin-1')} "
    matches = list(machine.iter(line)) if len(machine) and words else []
    if not matches:
        return None, set()
    hit, items = np.zeros(len(words), bool), set()
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(spaces, [end for end, _ in matches])
    for stop, (_, (length, own)) in zip(ends, matches, strict=True):
        hit[stop - length : stop] = True
        items.update(own)
    return hit, items


def _summary(text: str | None, count: int, hit: np.ndarray | None, items: set[str]) -> tuple:
    """n_words, n_hit, n_items, items and spans of one text."""
    if hit is None:
        return count, 0, 0, [], []
    return count, int(hit.sum()), len(items), sorted(items), _spans(text, hit)


def _spans(text: str, hit: np.ndarray) -> list[list[int]]:
    """Runs of hit words as character ranges of the original text."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    at = [m.span() for m in WORD.finditer(text)]
    return [[at[a][0], at[b - 1][1]] for a, b in edges.reshape(-1, 2)]


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is inside an occurrence, and one at all."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    aside, back = set_aside(docs, ["n_words", "n_hit", "n_items", "items", "spans"])
    clean = scan(aside, benchmark, width).where(~contaminated())
    return clean.select(*back(clean))
