"""Approximate neighbours: inverted lists whose vectors are product-quantised residuals.

A vector belongs to the list of its nearest centroid; what is left of it is cut into short
sub-vectors, each replaced by the nearest entry of a code book. A code takes one byte per
sub-vector. A search reads the codes of the lists nearest to it, and full vectors only for
the few songs that look best there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.operators import ranking
from upswell.operators.centres import SAMPLE, centres_of, count_for, nearest_centre, sampled
from upswell.operators.similarity import _distance, _held, _matrix, _titled, _unit, cosine_topk, vector_of
from upswell.session import materialize

#: Lists that a search looks into, and songs per search whose full vectors are read.
PROBES, RERANK = 32, 64
#: Codes and searches that meet in one task.
BLOCK = 65_536
_CODES = "list int, song_id bigint, bias float, code binary"


@dataclass(frozen=True)
class ListIndex:
    """Centroids (lists, size) and code books (sub-vectors, entries, values): all a search needs.

    It travels with the tasks: some 4 MB at most for 64 values a vector.
    """

    centres: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(
        cls,
        embeddings: DataFrame,
        lists: int | None = None,
        subvectors: int = 16,
        sample: int = SAMPLE,
        seed: int = 17,
    ) -> ListIndex:
        """Fitted on ``sample`` songs (the least seeded hashes of their ids); all songs can then be encoded.

        By default there are as many lists as the root of the number of songs, but no more
        than ``sample / ROWS_PER_CENTRE``. A last sub-vector is filled up with zeros.
        """
        held = _held(embeddings)
        if lists is None:
            lists = count_for(round(math.sqrt(held.count())), sample)
        some = sampled(held, sample, seed)
        if not some.num_rows:
            return cls(np.zeros((1, 1)), np.zeros((1, 1, 1)))
        rows = np.nan_to_num(_unit(_matrix(some["embedding"].combine_chunks())))
        draw = np.random.default_rng(seed)
        centres = centres_of(rows, lists, draw)
        left = cls._cut(rows - centres[nearest_centre(rows, centres)], subvectors)
        books = [centres_of(left[:, m], 256, draw) for m in range(left.shape[1])]
        return cls(centres, np.stack(books))

    @staticmethod
    def _cut(rows: np.ndarray, subvectors: int) -> np.ndarray:
        values = -(-rows.shape[1] // subvectors)
        return np.pad(rows, ((0, 0), (0, values * subvectors - rows.shape[1]))).reshape(len(rows), subvectors, values)

    def encode(self, embeddings: DataFrame) -> DataFrame:
        """``list, song_id, bias, code`` of every song with a vector: a narrow table to store.

        bias is the part of the distance that no search changes. A zero vector has no
        direction: it stands in list 0 behind all others.
        """
        fields = T.StructType([T.StructField(n, t) for n, t in (("list", T.IntegerType()), ("bias", T.FloatType()), ("code", T.BinaryType()))])

        @F.arrow_udf(fields)
        def coded(vectors: pa.Array) -> pa.Array:
            if len(vectors) == 0:
                return pa.array([], pa.struct([("list", pa.int32()), ("bias", pa.float32()), ("code", pa.binary())]))
            rows = _unit(_matrix(vectors))
            nowhere = np.isnan(rows).any(axis=1)
            rows = np.nan_to_num(rows)
            near = nearest_centre(rows, self.centres)
            left = self._cut(rows - self.centres[near], len(self.books))
            codes = np.stack([nearest_centre(left[:, m], book) for m, book in enumerate(self.books)], axis=1)
            made = np.stack([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1).reshape(len(rows), -1)
            centre = np.pad(self.centres, ((0, 0), (0, made.shape[1] - self.centres.shape[1])))[near]
            bias = ((2 * centre + made) * made).sum(axis=1)
            bias[nowhere], near[nowhere] = np.inf, 0
            code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            return pa.StructArray.from_arrays([pa.array(near, pa.int32()), pa.array(bias, pa.float32()), code], ["list", "bias", "code"])

        found = _held(embeddings).select("song_id", coded("embedding").alias("c"))
        return found.select("c.list", "song_id", "c.bias", "c.code")

    def probe(self, rows: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row the numbers of the nearest lists and their squared distances."""
        away = (self.centres * self.centres).sum(axis=1) - 2 * np.nan_to_num(rows) @ self.centres.T
        width = min(probes, away.shape[1])
        lists = np.argpartition(away, width - 1, axis=1)[:, :width]
        return lists, np.take_along_axis(away, lists, axis=1)

    def tables(self, rows: np.ndarray) -> np.ndarray:
        """Products of every row's sub-vectors with all entries of their books: (rows, sub-vectors, entries)."""
        cut = self._cut(np.nan_to_num(rows), len(self.books))
        return np.einsum("rmv,mev->rme", cut, self.books).astype(np.float32)


def _scores(tables: np.ndarray, codes: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(searches, songs): squared distances but for what a search has in common with all songs of a list."""
    total = np.zeros((len(tables), len(codes)), np.float32)
    for m in range(codes.shape[1]):
        total += tables[:, m][:, codes[:, m]]
    return bias - 2 * total


def _code_rows(codes: pa.Array, subvectors: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, subvectors)


def write_lists(codes: DataFrame, path: str) -> None:
    """Stores an index sorted by list, so that a search skips the files of other lists.

    A list longer than one file is cut by song.
    """
    codes.repartitionByRange("list", "song_id").sortWithinPartitions("list", "song_id").write.mode("overwrite").parquet(path)


def candidates(index: ListIndex, codes: DataFrame, queries: DataFrame, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """``query, song_id``: the ``rerank`` songs whose codes look nearest to each query.

    A list's codes and the searches that probe it meet in a task, in blocks of ``BLOCK`` at
    most on either side: a list with any share of the songs is cut, and so are the searches
    for it. Of each block a search keeps ``rerank`` songs.
    """
    routed = T.ArrayType(T.StructType([T.StructField("list", T.IntegerType()), T.StructField("away", T.FloatType())]))

    @F.arrow_udf(routed)
    def route(vectors: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("list", pa.int32()), ("away", pa.float32())]))
        if len(vectors) == 0:
            return pa.array([], kind)
        lists, away = index.probe(_unit(_matrix(vectors)), probes)
        flat = pa.StructArray.from_arrays([pa.array(lists.ravel(), pa.int32()), pa.array(away.ravel(), pa.float32())], ["list", "away"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * lists.shape[1], pa.int32()), flat)

    asked = materialize(
        _held(queries)
        .select(F.col("song_id").alias("query"), F.col("embedding").cast("array<float>").alias("asked"), F.explode(route("embedding")).alias("p"))
        .select("query", "asked", "p.list", "p.away")
    )
    # At most as many rows as there are lists.
    rows = codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("rows"))
    columns = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("columns"))
    parts = F.broadcast(rows.join(columns, "list"))
    own = lambda id, of: F.pmod(F.xxhash64(id), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    keys = ["list", "row", "column"]
    left = codes.join(parts, "list").select(*codes.columns, own("song_id", "rows").alias("row"), every("columns").alias("column"))
    right = asked.join(parts, "list").select(*asked.columns, every("rows").alias("row"), own("query", "columns").alias("column"))
    found = pa.schema([("query", pa.int64()), ("song_id", pa.int64()), ("score", pa.float32())])

    def scan(songs: pa.Table, searches: pa.Table) -> pa.Table:
        out = []
        if songs.num_rows and searches.num_rows:
            ids, bias = np.asarray(songs["song_id"]), np.asarray(songs["bias"])
            rows = _code_rows(songs["code"], len(index.books))
            asks, away = np.asarray(searches["query"]), np.asarray(searches["away"])
            units = _unit(_matrix(searches["asked"].combine_chunks()))
            step = max(1, (1 << 22) // len(ids))
            for at in range(0, len(asks), step):
                mine = asks[at : at + step]
                score = _scores(index.tables(units[at : at + step]), rows, bias) + away[at : at + step, None]
                score[mine[:, None] == ids[None, :]] = np.nan
                width = min(rerank, len(ids))
                # Equal codes are told apart by id, so that a rerun agrees.
                kth = np.partition(np.where(np.isnan(score), np.inf, score), width - 1, axis=1)[:, width - 1]
                row, column = np.nonzero(score <= kth[:, None])
                order = np.lexsort((ids[column], score[row, column], row))
                row, column = row[order], column[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < rerank
                row, column = row[keep], column[keep]
                out.append(pa.table([mine[row], ids[column], score[row, column]], schema=found))
        return pa.concat_tables(out) if out else found.empty_table()

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query bigint, song_id bigint, score float")
    return ranking.top_n_per(met, ["query"], rerank, F.col("score"), F.col("song_id")).select("query", "song_id")


def ann_topk_all(
    index: ListIndex,
    codes: DataFrame,
    embeddings: DataFrame,
    queries: DataFrame,
    k: int = 10,
    probes: int = PROBES,
    rerank: int = RERANK,
) -> DataFrame:
    """Approximate neighbours of every song of ``queries``: ``song_id, neighbour, dist, rank``.

    ``codes`` is the stored table of ``index``. Which songs compete is approximate; their
    distances are exact, equal ones rank by id, undefined ones come last as NULL.
    ``probes`` and ``rerank`` are the knobs.
    """
    met = materialize(candidates(index, codes, queries, probes, max(k, rerank)))
    asked = _held(queries).select(F.col("song_id").alias("query"), F.col("embedding").alias("_asked"))
    both = met.join(_held(embeddings), "song_id").join(asked, "query")

    @F.arrow_udf(T.DoubleType())
    def between(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], type=pa.float64())
        return pa.array(1.0 - (_unit(_matrix(a)) * _unit(_matrix(b))).sum(axis=1), type=pa.float64())

    dist = both.select(
        F.col("query").alias("song_id"), F.col("song_id").alias("neighbour"), F.nullif(between("embedding", "_asked"), F.lit(float("nan"))).alias("dist")
    )
    return ranking.top_n_per(dist, ["song_id"], k, F.col("dist").asc_nulls_last(), F.col("neighbour"))


def ann_topk(
    index: ListIndex,
    codes: DataFrame,
    embeddings: DataFrame,
    songs: DataFrame,
    song_id: int,
    k: int = 10,
    probes: int = PROBES,
    rerank: int = RERANK,
) -> DataFrame:
    """Approximate form of ``cosine_topk``: the codes of ``probes`` lists are read, and ``rerank`` vectors.

    Both are filters of the scans: the numbers of the lists, then the ids that look best.
    """
    vector = vector_of(embeddings, song_id)
    if vector is None or np.isnan(vector).any():
        return cosine_topk(embeddings, songs, song_id, k)
    (lists,), (away,) = index.probe(vector[None, :], probes)
    offset = np.full(len(index.centres), np.inf, np.float32)
    offset[lists] = away
    tables = index.tables(vector[None, :])

    @F.arrow_udf(T.FloatType())
    def score(number: pa.Array, bias: pa.Array, code: pa.Array) -> pa.Array:
        if len(number) == 0:
            return pa.array([], pa.float32())
        found = _scores(tables, _code_rows(code, len(index.books)), np.asarray(bias))[0]
        return pa.array(found + offset[np.asarray(number)], pa.float32())

    probed = codes.where(F.col("list").isin([int(x) for x in lists]) & (F.col("song_id") != song_id))
    best = probed.select("song_id", score("list", "bias", "code").alias("score")).orderBy("score", "song_id").limit(max(k, rerank))
    ids = [r.song_id for r in best.collect()]
    near = _held(embeddings).where(F.col("song_id").isin(ids) if ids else F.lit(False))
    return _titled(near.select("song_id", _distance(vector)("embedding").alias("dist")), songs, k)
