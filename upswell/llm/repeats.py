"""Removal of byte strings that already occurred in an earlier document.

A suffix array of the whole corpus would move some hundred bytes for every byte of text.
Only suffixes that share ``LENGTH`` bytes with another document's are ever compared, so
the work is dealt out by content instead. Of a window of ``LENGTH`` bytes, the least hash
of its ``GRAM``-byte strings depends on the window alone: equal windows meet in the same
shard, and a window whose least hash no other document has is unique. Consecutive windows
with one least hash travel as one segment. Each shard sorts the suffixes of its distinct
segments with a difference cover and compares the prefixes of neighbours. Where too many
different segments have one least hash, their windows are dealt one by one instead, by a
hash of the whole window.

Texts move three times, packed and compressed, next to what the shards answer.
"""

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import partitions_for, shuffle_width
from upswell.llm.suffixes import first_owner, ranked, words
from upswell.session import materialize

LENGTH = 50
GRAM = 20
#: Documents are packed into batches of about this many bytes.
BATCH_BYTES = 4 << 20
#: Text of the corpus per shard; a shard sees what other documents share of it.
SHARD_BYTES = 32 << 20
#: Different segments of one key, at most, that are not dealt window by window.
SORT_BYTES = 2 << 20
#: Inside a shard suffixes are sorted in groups of this many bytes, which stay in a core's cache.
GROUP_BYTES = 128 << 10
#: Hashes and windows are looked at in pieces of this many bytes.
BLOCK_BYTES = 1 << 20
#: Segments of a key that a batch has no more bytes of count as this many.
LIGHT_BYTES = 256
#: Text of the corpus per file of what the shards answer: a few bits for every key and window.
ANSWERED_BYTES = 256 << 20

_PACKED = "batch bigint, ids binary, sizes binary, text binary"
_ANSWER = "batch bigint, kind int, shard int, bits binary"
#: Kinds of answers: keys of two documents, keys split by windows, windows of smaller owners.
_SHARED, _SPLIT, _OWNED = 1, 3, 2
_SEGMENTS = "shard int, batch bigint, sizes binary, owners binary, parts binary, text binary"
_RESULT = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string,"
    " spans array<array<bigint>>"
)
#: Stands for a NULL doc_id, which is smaller than any other.
_NULL_ID = -(1 << 63)


#: Where the words of 8 bytes start that cover a window.
_PLACES = (*range(0, LENGTH - 7, 8), LENGTH - 8)


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


def _least_hashes(data: np.ndarray) -> np.ndarray:
    """For every window, the least hash of the strings of ``GRAM`` bytes in it."""
    eight = words(data)
    last = len(data) - GRAM + 1
    hashes = eight[:last] * np.uint64(0x9E3779B97F4A7C15)
    hashes += eight[8 : 8 + last] * np.uint64(0xC2B2AE3D27D4EB4F)
    hashes ^= eight[12 : 12 + last] * np.uint64(0x165667B19E3779F9)
    hashes = _mix(hashes)
    span, wide = LENGTH - GRAM + 1, 1
    while 2 * wide <= span:
        hashes = np.minimum(hashes[: len(hashes) - wide], hashes[wide:])
        wide *= 2
    rest = span - wide
    return np.minimum(hashes[: len(hashes) - rest], hashes[rest:]) if rest else hashes


def _window_hashes(eight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of whole windows, from the 8 bytes at every position."""
    hashes = np.zeros(len(at), np.uint64)
    for place in _PLACES:
        hashes = _mix((hashes ^ eight[at + place]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return hashes


class Pieces(NamedTuple):
    """What a batch sends: where each piece starts and in which document, the distinct strings,
    which string each piece is, and the least doc_id and the key of each string."""

    at: np.ndarray
    doc: np.ndarray
    strings: list[bytes]
    which: np.ndarray
    least: np.ndarray
    key: np.ndarray


class Batch:
    """Whole documents side by side, and their segments: runs of windows with one least hash."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.data = np.frombuffer(_expand(text), np.uint8)
        self.ends = np.cumsum(np.frombuffer(sizes, np.int64))
        self.starts = self.ends - np.frombuffer(sizes, np.int64)
        self.at, self.count, self.key = self._segments()
        self.doc = np.searchsorted(self.ends, self.at, "right")

    def _segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.data) - LENGTH + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        valid = np.ones(n, bool)
        for start, end in zip(self.starts, self.ends, strict=True):
            valid[max(start, end - LENGTH + 1) : end] = False
        least = np.concatenate(
            [_least_hashes(self.data[a : a + BLOCK_BYTES + LENGTH - 1]) for a in range(0, n, BLOCK_BYTES)]
        )
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        at = np.flatnonzero(new & valid)
        # A run ends where the next one or an invalid start comes.
        stop = np.append(np.flatnonzero(new | ~valid), n)
        end = stop[np.searchsorted(stop, at, "right")]
        # The least hashes are small numbers; mixed again they deal out evenly.
        return at, end - at, _mix(least[at] + np.uint64(1))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys in order, which key each segment has, and which keys two documents have."""
        keys, _, nth = ranked(self.key)
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), _NULL_ID)
        owner = self.ids[self.doc]
        np.minimum.at(low, nth, owner)
        np.maximum.at(high, nth, owner)
        return keys, nth, low < high

    def weights(self, keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Bytes of the distinct segments of every key, exact where they are above ``LIGHT_BYTES``."""
        size = self.count + LENGTH - 1
        held = np.bincount(nth, size, len(keys)).astype(np.int64)
        some = np.flatnonzero(held[nth] > LIGHT_BYTES)
        if len(some):
            raw, found = self.data.tobytes(), set()
            for i, start, length in zip(some, self.at[some].tolist(), size[some].tolist(), strict=True):
                string = raw[start : start + length]
                if string in found:
                    held[nth[i]] -= length
                else:
                    found.add(string)
        return held

    def shared(self, shards: int, answers: pa.Table) -> Pieces:
        """The segments that may occur in two documents, those of split keys as single windows."""
        keys, nth, _ = self.distinct()
        places_of = _grouped(keys % np.uint64(shards))

        def told(kind: int) -> np.ndarray:
            marked = np.zeros(len(keys), bool)
            for shard, bits in _by_shard(answers, kind).items():
                own = places_of(shard)
                marked[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
            return marked[nth]

        chosen, split = told(_SHARED), told(_SPLIT)
        whole, single = np.flatnonzero(chosen & ~split), np.flatnonzero(chosen & split)
        raw, known, which = self.data.tobytes(), {}, np.empty(len(whole), np.int64)
        for i, k in enumerate(whole):
            start = self.at[k]
            which[i] = known.setdefault(raw[start : start + self.count[k] + LENGTH - 1], len(known))
        key = np.zeros(len(known), np.uint64)
        key[which] = self.key[whole]
        at, doc, strings = self.at[whole], self.doc[whole], list(known)
        if len(single):
            # Equal windows have one least hash, so none of these is among the whole segments.
            count = self.count[single]
            place = np.repeat(self.at[single], count) + _inside(count)
            nth_window, first, own_key = self._windows(place)
            which = np.concatenate((which, nth_window + len(strings)))
            strings += [raw[start : start + LENGTH] for start in first.tolist()]
            key = np.concatenate((key, own_key))
            at, doc = np.concatenate((at, place)), np.concatenate((doc, np.repeat(self.doc[single], count)))
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, which, self.ids[doc])
        return Pieces(at, doc, strings, which, least, key)

    def _windows(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which distinct window stands at each place, where each is first, and its hash."""
        eight = words(self.data)
        hashes = _window_hashes(eight, place)
        own_key, index, nth = ranked(hashes)
        first = place[index]
        odd = np.zeros(len(place), bool)
        for at in _PLACES:
            odd |= eight[place + at] != eight[first[nth] + at]
        # Different windows of one hash: told apart by their bytes.
        extra: dict[bytes, int] = {}
        for i in np.flatnonzero(odd):
            window = self.data[place[i] : place[i] + LENGTH].tobytes()
            if window not in extra:
                extra[window] = len(first)
                first, own_key = np.append(first, place[i]), np.append(own_key, hashes[i])
            nth[i] = extra[window]
        return nth, first, own_key


def _inside(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts, side by side."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _grouped(values: np.ndarray) -> Callable[[int], np.ndarray]:
    """Where each value stands, in ascending order: sorted once, however many values are asked for."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    return lambda value: order[slice(*np.searchsorted(ordered, np.array([value, value + 1], values.dtype)))]


def _pack(batch_bytes: int) -> Callable:
    """Documents of a partition as rows of ``_PACKED``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64).tobytes()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    pa.array([sizes], pa.binary()),
                    pa.array([_squeeze(b"".join(texts))], pa.binary()),
                ],
                ["batch", "ids", "sizes", "text"],
            )

        for batch in batches:
            own, text = batch.column(0), batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                doc_id, data = own[i].as_py(), text[i].as_py() or b""
                if texts and held + len(data) > batch_bytes:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(_NULL_ID if doc_id is None else doc_id)
                texts.append(data)
                held += len(data)
        if texts:
            yield row()

    return pack


def _offers(shards: int) -> Callable:
    """Every batch's distinct keys, to the shards: 5 bytes each, the last bit for keys of two documents.

    Keys with many bytes of segments go a second time, with their place and these bytes.
    """

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                batch = Batch(row["ids"], row["sizes"], row["text"])
                keys, nth, repeated = batch.distinct()
                order = np.argsort(keys % np.uint64(shards), kind="stable")
                tags = ((keys >> np.uint64(25)) << np.uint64(1) | repeated)[order].astype("<u8")
                packed = tags.view(np.uint8).reshape(-1, 8)[:, :5]
                own = (keys % np.uint64(shards))[order]
                heads = np.flatnonzero(np.diff(own, prepend=np.uint64(shards)))
                blobs = [p.tobytes() for p in np.split(packed, heads[1:])] if len(own) else []
                held = batch.weights(keys, nth)[order]
                pairs = [
                    np.stack((heavy, part[heavy])).astype("<i8").tobytes()
                    for part in (np.split(held, heads[1:]) if len(own) else [])
                    for heavy in [np.flatnonzero(part > LIGHT_BYTES)]
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[heads].astype(np.int32), pa.int32()),
                        pa.array([row["batch"]] * len(heads), pa.int64()),
                        pa.array(blobs, pa.binary()),
                        pa.array(pairs, pa.binary()),
                    ],
                    ["shard", "batch", "tags", "heavy"],
                )

    return offer


def _answer_offers(sort_bytes: int) -> Callable:
    """For each batch, which of the keys it offered to this shard two documents have, and which
    of those may have over ``sort_bytes`` of distinct segments: these are split by windows."""

    def answer(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py() if rows.num_rows else 0
        offered = [np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, 5) for b in rows.column("tags")]
        wide = np.zeros((sum(map(len, offered)), 8), np.uint8)
        wide[:, :5] = np.concatenate(offered)
        tags = wide.reshape(-1).view("<u8")
        keys, _, nth = ranked(tags >> np.uint64(1))
        times = np.bincount(nth, minlength=len(keys))
        shared = times > 1
        shared[nth[(tags & np.uint64(1)) == 1]] = True
        sizes = [len(o) for o in offered]
        # No less than the key has: a batch that names no bytes has LIGHT_BYTES at most.
        held = times * LIGHT_BYTES
        for start, pairs in zip(np.cumsum(sizes) - sizes, rows.column("heavy"), strict=True):
            place, own = np.frombuffer(pairs.as_buffer(), "<i8").reshape(2, -1)
            np.add.at(held, nth[start + place], own - LIGHT_BYTES)
        cuts = np.cumsum(sizes)[:-1]
        batches = rows.column("batch").to_pylist()
        told = _answers(batches, shard, _SHARED, np.split(shared[nth], cuts))
        split = _answers(batches, shard, _SPLIT, np.split((shared & (held > sort_bytes))[nth], cuts))
        return pa.concat_tables([told, split])

    return answer


def _answers(batches: list[int], shard: int, kind: int, bits: list[np.ndarray]) -> pa.Table:
    told = [(b, np.packbits(x).tobytes()) for b, x in zip(batches, bits, strict=True) if x.any()]
    return pa.table(
        {
            "batch": pa.array([b for b, _ in told], pa.int64()),
            "kind": pa.array([kind] * len(told), pa.int32()),
            "shard": pa.array([shard] * len(told), pa.int32()),
            "bits": pa.array([x for _, x in told], pa.binary()),
        }
    )


def _by_shard(answers: pa.Table, kind: int) -> dict[int, bytes]:
    own = answers.select(["kind", "shard", "bits"]).filter(pc.field("kind") == kind)
    return dict(zip(own["shard"].to_pylist(), own["bits"].to_pylist(), strict=True))


def _send(shards: int) -> Callable:
    """A batch's distinct segments that two documents may share, to the shards of their keys."""

    def send(packed: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("shard", "batch", "sizes", "owners", "parts", "text")}
        for row in packed.to_pylist():
            batch = Batch(row["ids"], row["sizes"], row["text"])
            _, _, strings, _, least, key = batch.shared(shards, answers)
            of_shard = key % np.uint64(shards)
            places_of = _grouped(of_shard)
            for shard in np.unique(of_shard).tolist():
                own = places_of(shard)
                out["shard"].append(int(shard))
                out["batch"].append(row["batch"])
                out["sizes"].append(_squeeze(np.array([len(strings[k]) for k in own], np.int32).tobytes()))
                out["owners"].append(_squeeze(least[own].tobytes()))
                out["parts"].append((key[own] >> np.uint64(48)).astype(np.uint16).tobytes())
                out["text"].append(_squeeze(b"".join(strings[k] for k in own)))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    return send


def _sort(sort_bytes: int) -> Callable:
    """For each batch, which windows of the segments it sent to this shard have a smaller owner."""

    def sort(rows: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        which, owners, parts = [], [], []
        for row in rows.to_pylist():
            text, at, own = _expand(row["text"]), 0, []
            for size in np.frombuffer(_expand(row["sizes"]), np.int32).tolist():
                own.append(known.setdefault(text[at : at + size], len(known)))
                at += size
            which.append(np.array(own, np.int64))
            owners.append(np.frombuffer(_expand(row["owners"]), np.int64))
            parts.append(np.frombuffer(row["parts"], np.uint16))
        strings = list(known)
        every = np.concatenate(which)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, every, np.concatenate(owners))
        part = np.zeros(len(strings), np.uint16)
        part[every] = np.concatenate(parts)
        windows = np.array([len(s) for s in strings]) - LENGTH + 1
        places = np.cumsum(windows) - windows
        first = np.empty(int(windows.sum()), np.int64)
        # Equal windows have equal parts, so groups of parts are sorted one after the other.
        groups = -(-sum(map(len, strings)) // min(sort_bytes, GROUP_BYTES))
        group = part % groups
        for nth in range(groups):
            own = np.flatnonzero(group == nth)
            if len(own):
                for k, found in zip(own, first_owner([strings[k] for k in own], least[own], LENGTH), strict=True):
                    first[places[k] : places[k] + windows[k]] = found
        bits = []
        for own, owner in zip(which, owners, strict=True):
            count = windows[own]
            bits.append(first[np.repeat(places[own], count) + _inside(count)] < np.repeat(owner, count))
        return _answers(rows.column("batch").to_pylist(), rows.column("shard")[0].as_py(), _OWNED, bits)

    return sort


def _cut(shards: int) -> Callable:
    """What is left of a batch's documents."""

    def cut(packed: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in packed.to_pylist():
            batch = Batch(row["ids"], row["sizes"], row["text"])
            at, doc, strings, which, least, key = batch.shared(shards, answers)
            count = np.array([len(s) for s in strings], np.int64) - LENGTH + 1
            places = np.cumsum(count) - count
            repeated = np.zeros(int(count.sum()), bool)
            places_of = _grouped(key % np.uint64(shards))
            for shard, bits in _by_shard(answers, _OWNED).items():
                own = places_of(shard)
                size = count[own]
                told = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(size.sum())).astype(bool)
                repeated[np.repeat(places[own], size) + _inside(size)] = told
            # Every window of the pieces: is an equal one in a smaller document?
            size = count[which]
            inside = _inside(size)
            start = np.repeat(at, size) + inside
            later = batch.ids[doc] > least[which]
            gone = repeated[np.repeat(places[which], size) + inside] | np.repeat(later, size)
            edges = np.zeros(len(batch.data) + 1, np.int32)
            np.add.at(edges, start[gone], 1)
            np.add.at(edges, start[gone] + LENGTH, -1)
            removed = np.cumsum(edges[:-1]) > 0
            for doc_id, a, b in zip(batch.ids, batch.starts, batch.ends, strict=True):
                own = removed[a:b]
                spans = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])))).reshape(-1, 2)
                out.append(
                    {
                        "doc_id": None if doc_id == _NULL_ID else int(doc_id),
                        "n_bytes": int(b - a),
                        "n_removed": int(own.sum()),
                        "n_spans": len(spans),
                        "kept_sha256": hashlib.sha256(batch.data[a:b][~own].tobytes()).hexdigest(),
                        "spans": spans.tolist(),
                    }
                )
        integer = pa.int64()
        kinds = [integer, integer, integer, integer, pa.string(), pa.list_(pa.list_(integer))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        return pa.Table.from_pylist(out, pa.schema(list(zip(names, kinds, strict=True))))

    return cut


def repeated_spans(
    docs: DataFrame,
    batch_bytes: int = BATCH_BYTES,
    shard_bytes: int = SHARD_BYTES,
    sort_bytes: int = SORT_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs``.

    A byte of a text in UTF-8 is removed if a string of ``LENGTH`` bytes covers it that
    also starts in a document with a smaller doc_id. spans has the maximal removed runs as
    [start, end) in bytes. Everything is judged on the input, not on what is left.

    A batch sends each distinct key and segment once, however many of its documents have
    it, so the inside of a passage in a third of all documents costs a shard one row per
    batch. Its ends, which every document continues in its own way, are as many different
    segments under one key: a key that may have over ``sort_bytes`` of them is split, and
    its windows are dealt over all shards. Shards grow in number with the corpus; in a
    shard, suffixes are sorted some ``GROUP_BYTES`` at a time. All steps repeat exactly from the packed documents, which are written once.

    NULL texts count as empty. Rows with one doc_id do not remove from each other; a NULL
    doc_id is smaller than any other. Texts under ``LENGTH`` bytes keep everything. One
    very long text takes some forty times its size in a task. Other columns are not read.
    An empty table gives no rows.
    """
    chosen = docs.select(F.col("doc_id").cast("long"), "text")
    packed = materialize(chosen.mapInArrow(_pack(batch_bytes), _PACKED))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    shards = partitions_for(total, shard_bytes, shuffle_width(docs))
    offers = packed.mapInArrow(_offers(shards), "shard int, batch bigint, tags binary, heavy binary")
    # Every shard answers in a few kilobytes: files follow the text, not the shards.
    files = partitions_for(total, ANSWERED_BYTES)
    first = offers.groupBy("shard").applyInArrow(_answer_offers(sort_bytes), _ANSWER)
    first = materialize(first.repartition(files))
    segments = packed.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(_send(shards), _SEGMENTS)
    second = segments.groupBy("shard").applyInArrow(_sort(sort_bytes), _ANSWER)
    answers = first.unionByName(materialize(second.repartition(files)))
    found = packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_cut(shards), _RESULT)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
