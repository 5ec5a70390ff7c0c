"""Song texts and vectors: stale detection, cosine neighbours, exact and approximate."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.functions.documents import source_text
from upswell.functions.scores import effective_tag
from upswell.operators import ranking
from upswell.operators.centres import SAMPLE, centres_of, count_for, nearest_centre, sampled
from upswell.session import materialize


def collect_artists(song_artists: DataFrame, artists: DataFrame) -> DataFrame:
    """Distinct artist names per song, in code-point order."""
    named = song_artists.join(artists.select(F.col("id").alias("artist_id"), "name"), "artist_id")
    return named.groupBy("song_id").agg(F.array_sort(F.collect_set("name")).alias("artists"))


def collect_tags(song_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct effective tags per song, in code-point order."""
    shown = effective_tag(F.col("canon_status"), F.col("canon_name"), F.col("name"))
    named = song_tags.join(tags.select(F.col("id").alias("tag_id"), shown.alias("tag")), "tag_id")
    return named.groupBy("song_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def source_rows(
    songs: DataFrame, song_artists: DataFrame, artists: DataFrame, song_tags: DataFrame, tags: DataFrame
) -> DataFrame:
    """Per song: title, type, artist names and tags (empty arrays where there are none).

    Both collections leave their rows partitioned by song, which the joins reuse.
    """
    none = F.array().cast("array<string>")
    return (
        songs.select(F.col("id").alias("song_id"), "title", "song_type")
        .join(collect_artists(song_artists, artists), "song_id", "left")
        .join(collect_tags(song_tags, tags), "song_id", "left")
        .select(
            "song_id",
            "title",
            "song_type",
            F.coalesce("artists", none).alias("artists"),
            F.coalesce("tags", none).alias("tags"),
        )
    )


def select_stale(rows: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Songs whose text or model differs from what is stored, with the new text.

    The join is on the song alone, by which ``rows`` is partitioned already; of the stored
    texts only 128-bit digests move.
    """
    text = source_text(F.col("title"), F.col("song_type"), F.col("artists"), F.col("tags"))
    current = rows.select("song_id", text.alias("source_text"))
    known = stored.where(F.col("model") == model).select("song_id", F.md5("source_text").alias("_known"))
    joined = current.join(known, "song_id", "left")
    return joined.where(~F.col("_known").eqNullSafe(F.md5("source_text"))).drop("_known")


def parse_vectors(responses: DataFrame) -> DataFrame:
    """Embedding responses to vectors in input order.

    ``responses`` has ``batch_no, n, raw`` and one row per batch, whose size the
    sender fixed. A batch counts only if it has ``n`` items with each index from 0
    to ``n - 1`` once, every one with a vector; otherwise none of it does.
    Result: ``batch_no, index, embedding``.
    """
    items = F.from_json(
        F.get_json_object("raw", "$.data"), "array<struct<index:int,embedding:array<float>>>"
    )
    parsed = responses.select("batch_no", "n", items.alias("items"))
    indexes = F.array_sort(F.transform("items", lambda i: i["index"]))
    expected = F.sequence(F.lit(0), F.col("n") - 1)
    usable = F.forall("items", lambda i: i["embedding"].isNotNull())
    complete = (F.size("items") == F.col("n")) & usable & (indexes == expected)
    whole = parsed.where((F.col("n") > 0) & F.coalesce(complete, F.lit(False)))
    return whole.select("batch_no", F.explode("items").alias("i")).select("batch_no", "i.*")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list array as doubles, without visiting single values.

    All rows must have one length and no missing value: anything else would shift values
    from one vector into the next.
    """
    sizes = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or len(set(sizes.tolist())) > 1:
        raise ValueError("embeddings must all be present and have one size")
    values = vectors.flatten()
    if values.null_count:
        raise ValueError("an embedding has a NULL value")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row becomes NaN, as its distance is undefined."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _held(embeddings: DataFrame) -> DataFrame:
    """Songs that have a vector."""
    return embeddings.where(F.col("embedding").isNotNull()).select("song_id", "embedding")


def vector_of(embeddings: DataFrame, song_id: int) -> np.ndarray | None:
    """One song's vector scaled to length 1: the one row a single search brings to the driver."""
    row = _held(embeddings).where(F.col("song_id") == song_id).first()
    return None if row is None else _unit(np.array([row["embedding"]], np.float64))[0]


def _distance(reference: np.ndarray):
    """Cosine distance of a vector column to one vector, which travels with the task."""

    @F.arrow_udf(T.DoubleType())
    def distance(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], type=pa.float64())
        return pa.array(1.0 - _unit(_matrix(vectors)) @ reference, type=pa.float64())

    return distance


def distance_to(embeddings: DataFrame, song_id: int) -> DataFrame:
    """Cosine distance of every other song to one song; no rows for an unknown song.

    One scan, no shuffle. Measured on 200,000 vectors of 64 floats, Arrow batches took half
    the time of higher-order functions.
    """
    reference = vector_of(embeddings, song_id)
    others = _held(embeddings).where(F.col("song_id") != song_id)
    if reference is None:
        return others.limit(0).select("song_id", F.lit(None).cast("double").alias("dist"))
    return others.select("song_id", _distance(reference)("embedding").alias("dist"))


def _nearest(column: str = "dist") -> list[Column]:
    """Order of neighbours: undefined distances last, equal ones by id."""
    return [F.col(column).asc_nulls_last(), F.asc("song_id")]


def _titled(near: DataFrame, songs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of ``near`` with their titles: the limit comes before the join."""
    best = near.orderBy(*_nearest()).limit(k)
    titled = best.join(songs.select(F.col("id").alias("song_id"), "title"), "song_id")
    return titled.select("song_id", "title", "dist").orderBy(*_nearest())


def cosine_topk(embeddings: DataFrame, songs: DataFrame, song_id: int, k: int = 10) -> DataFrame:
    """The ``k`` nearest songs with title and distance.

    Every embedding belongs to a stored song (the write checks it), so ``k`` rows are taken
    first and only they are joined to the catalogue.
    """
    return _titled(distance_to(embeddings, song_id), songs, k)


_FOUND = pa.schema([("song_id", pa.int64()), ("neighbour", pa.int64()), ("dist", pa.float64())])
#: Added to bounds, so that rounding never hides a neighbour.
_SLACK = 1e-6


def _best(k: int, ids: np.ndarray, units: np.ndarray, others: np.ndarray, other_units: np.ndarray) -> list[pa.Table]:
    """The ``k`` nearest ``others`` of every id, equal ones by id; undefined distances are infinite."""
    out = []
    # Slices of one block bound the distance matrix held at once.
    for at in range(0, len(ids), 1024):
        part = ids[at : at + 1024]
        # Equal vectors have equal distances, whatever block they are met in.
        dist = units[at : at + 1024] @ other_units.T
        np.round(np.subtract(1.0, dist, out=dist), 12, out=dist)
        dist[np.isnan(dist)] = np.inf
        dist[part[:, None] == others[None, :]] = np.nan
        # All that are no further than the k-th: ties are settled by id below.
        kth = np.partition(dist, min(k, dist.shape[1]) - 1, axis=1)[:, min(k, dist.shape[1]) - 1]
        row, column = np.nonzero((dist <= kth[:, None]) | (np.isnan(kth)[:, None] & ~np.isnan(dist)))
        order = np.lexsort((others[column], dist[row, column], row))
        row, column = row[order], column[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        row, column = row[keep], column[keep]
        out.append(pa.table([part[row], others[column], dist[row, column]], schema=_FOUND))
    return out


class Cells:
    """Vectors dealt to the cell of their nearest centre, each cell with its radius.

    A vector's chord to anything in a cell is at least its chord to the centre less the
    radius: cells that are further than a known neighbour hold no nearer one. Centres come
    from a bounded sample; a cell of more than ``block_rows`` vectors has several parts.
    """

    def __init__(self, held: DataFrame, block_rows: int, sample: int = SAMPLE, seed: int = 17):
        wanted = count_for(math.ceil(held.count() / block_rows), sample)
        some = sampled(held, sample, seed) if wanted > 1 else None
        if some is None:
            self.centres = None
            cell = F.struct(F.lit(0).alias("cell"), F.lit(2.0).alias("away"))
        else:
            rows = np.nan_to_num(_unit(_matrix(some["embedding"].combine_chunks())))
            self.centres = centres_of(rows, wanted, np.random.default_rng(seed))
            cell = self._assigned()("embedding")
        near = held.select("song_id", "embedding", cell.alias("c")).select("song_id", "embedding", "c.cell", "c.away")
        self.sizes: dict[int, int] = {}
        self.radius = np.zeros(wanted)
        near = materialize(near)
        # One row per cell.
        for row in near.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
            self.sizes[row.cell], self.radius[row.cell] = row.n, row.radius
        self.parts = {cell: math.ceil(n / block_rows) for cell, n in self.sizes.items()}
        crowded = [F.when(F.col("cell") == c, F.lit(p)) for c, p in self.parts.items() if p > 1]
        parts = F.coalesce(*crowded, F.lit(1)) if crowded else F.lit(1)
        self.placed = near.drop("away").withColumn("part", F.pmod(F.xxhash64("song_id"), parts).cast("int"))

    def _assigned(self):
        fields = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
        centres = self.centres

        @F.arrow_udf(fields)
        def assigned(vectors: pa.Array) -> pa.Array:
            rows = _unit(_matrix(vectors)) if len(vectors) else np.zeros((0, centres.shape[1]))
            rows = np.nan_to_num(rows)
            near = nearest_centre(rows, centres)
            away = np.sqrt(((rows - centres[near]) ** 2).sum(axis=1))
            return pa.StructArray.from_arrays([pa.array(near, pa.int32()), pa.array(away)], ["cell", "away"])

        return assigned

    def reached(self):
        """A column function of (vector, distance of its k-th neighbour so far, own cell, own part):
        the blocks that may hold a nearer one, its own left out."""
        places = T.ArrayType(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType())]))
        cells, centres, radius = np.array(sorted(self.sizes), np.int64), self.centres, self.radius
        counts = np.array([self.parts[c] for c in cells.tolist()], np.int64)
        # All blocks side by side: the cell (by its place in ``cells``) and the part of each.
        heads = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(cells)), counts)
        block_cell, block_part = cells[of].astype(np.int32), (np.arange(len(of)) - heads[of]).astype(np.int32)

        def near_cells(vectors: pa.Array, bound: np.ndarray) -> np.ndarray:
            if centres is None:
                return np.ones((len(vectors), len(cells)), bool)
            # Chords: the square is twice the cosine distance. A zero vector reaches everything.
            rows = np.nan_to_num(_unit(_matrix(vectors)))
            away = np.sqrt(np.maximum((rows * rows).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * rows @ centres.T, 0))
            return (away - radius)[:, cells] <= np.sqrt(2 * np.maximum(bound, 0))[:, None] + _SLACK

        @F.arrow_udf(places)
        def reach(vectors: pa.Array, kth: pa.Array, cell: pa.Array, part: pa.Array) -> pa.Array:
            own = heads[np.searchsorted(cells, np.asarray(cell))] + np.asarray(part)
            bound = np.asarray(kth, np.float64)
            found, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            # Blocks go out as numbers; slices bound the table of songs by blocks held at once.
            for at in range(0, len(vectors), 1024):
                near = near_cells(vectors[at : at + 1024], bound[at : at + 1024])[:, of]
                near[np.arange(len(near)), own[at : at + 1024]] = False
                found.append(np.nonzero(near)[1].astype(np.int32))
                sizes.append(near.sum(axis=1))
            block = np.concatenate(found)
            pairs = pa.StructArray.from_arrays([pa.array(block_cell[block]), pa.array(block_part[block])], ["cell", "part"])
            return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pairs)

        return reach


def bounded(cells: Cells, k: int) -> DataFrame:
    """Every song with its ``k`` nearest of its own block, and the distance that any nearer one must beat."""
    near = pa.list_(pa.struct([("neighbour", pa.int64()), ("dist", pa.float64())]))

    def own_block(rows: pa.Table) -> pa.Table:
        ids = np.asarray(rows["song_id"])
        units = _unit(_matrix(rows["embedding"].combine_chunks()))
        found = pa.concat_tables(_best(k, ids, units, ids, units))
        by: dict[int, list] = {}
        for song, other, dist in zip(found["song_id"].to_pylist(), found["neighbour"].to_pylist(), found["dist"].to_pylist()):
            by.setdefault(song, []).append({"neighbour": other, "dist": dist})
        lists = [by.get(i, []) for i in ids.tolist()]
        kth = [each[-1]["dist"] if len(each) == k else float("inf") for each in lists]
        return rows.append_column("kth", pa.array(kth, pa.float64())).append_column("near", pa.array(lists, near))

    vector = cells.placed.schema["embedding"].dataType.simpleString()
    kinds = f"song_id bigint, embedding {vector}, cell int, part int, kth double, near array<struct<neighbour:bigint,dist:double>>"
    return materialize(cells.placed.groupBy("cell", "part").applyInArrow(own_block, kinds))


def block_questions(cells: Cells, known: DataFrame) -> DataFrame:
    """``song_id, embedding, cell, part``: every song with each other block that may hold a nearer one."""
    blocks = cells.reached()("embedding", "kth", "cell", "part")
    return known.select("song_id", "embedding", F.explode(blocks).alias("b")).select("song_id", "embedding", "b.cell", "b.part")


def cosine_topk_all(embeddings: DataFrame, k: int = 10, block_rows: int = 8192) -> DataFrame:
    """The ``k`` nearest songs of every song, exactly: ``song_id, neighbour, dist, rank``.

    Vectors are dealt to cells of about ``block_rows``. A song first finds its nearest in its
    own block; their distances tell which other cells may hold a nearer one, by the triangle
    inequality on chords, and only to these the song is sent. A block and the songs that
    reach it meet in tasks of bounded size as matrix products, of which every song keeps its
    best ``k`` at once: never all pairs leave a task.

    On clustered vectors most cells are out of reach. On vectors without structure none is,
    and the work grows with the square of the songs; ``quantised.ann_topk_all`` is the way
    for very large sets of that kind.
    """
    held = _held(embeddings)
    kinds = "song_id bigint, neighbour bigint, dist double"
    if held.count() <= block_rows:  # one block, one product

        def alone(rows: pa.Table) -> pa.Table:
            ids, units = np.asarray(rows["song_id"]), _unit(_matrix(rows["embedding"].combine_chunks()))
            return pa.concat_tables(_best(k, ids, units, ids, units))

        found = held.withColumn("_block", F.lit(0)).groupBy("_block").applyInArrow(alone, kinds)
        return _ranked(found, k)
    cells = Cells(held, block_rows)
    known = bounded(cells, k)
    asked = block_questions(cells, known)
    # One row per block: songs that reach it, in columns of bounded size.
    columns = materialize(asked.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / (4 * block_rows)).alias("columns")))
    keys = ["cell", "part", "column"]
    left = cells.placed.join(columns, ["cell", "part"])
    left = left.select("song_id", "embedding", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("column"))
    right = asked.join(columns, ["cell", "part"]).withColumn("column", F.pmod(F.xxhash64("song_id"), F.col("columns"))).drop("columns")

    def block(songs: pa.Table, questions: pa.Table) -> pa.Table:
        if not songs.num_rows or not questions.num_rows:
            return _FOUND.empty_table()
        units = [_unit(_matrix(t["embedding"].combine_chunks())) for t in (questions, songs)]
        return pa.concat_tables(_best(k, np.asarray(questions["song_id"]), units[0], np.asarray(songs["song_id"]), units[1]))

    far = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, kinds)
    own = known.select("song_id", F.explode("near").alias("n")).select("song_id", "n.neighbour", "n.dist")
    return _ranked(own.unionByName(far), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = ranking.top_n_per(found, ["song_id"], k, F.col("dist"), F.col("neighbour"))
    return ranked.withColumn("dist", F.nullif("dist", F.lit(float("inf"))))


class SignIndex:
    """Banded sign signatures: how vectors are hashed into buckets, and where to look for one.

    A band takes the signs of ``bits`` random projections as one bucket number: all bits of
    a band must agree, any band may. A search also probes the buckets whose differing bits
    have the smallest projections; ``probes`` buckets per band are its width.
    """

    def __init__(self, size: int, bands: int = 48, bits: int = 14, seed: int = 17):
        self.bands, self.bits = bands, bits
        self.planes = np.random.default_rng(seed).normal(size=(size, bands * bits))

    def _projected(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.planes).reshape(len(rows), self.bands, self.bits)

    def buckets(self, embeddings: DataFrame) -> DataFrame:
        """``band, bucket, song_id``: a narrow table to store, partitioned by band."""
        weights = 1 << np.arange(self.bits)

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def signed(vectors: pa.Array) -> pa.Array:
            if len(vectors) == 0:
                return pa.array([], pa.list_(pa.int32()))
            keys = ((self._projected(_matrix(vectors)) > 0) * weights).sum(axis=2)
            return pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32()))

        held = _held(embeddings)
        return held.select("song_id", F.posexplode(signed("embedding")).alias("band", "bucket"))

    def probe(self, vector: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The (band, bucket) pairs to look into: per band the likeliest ``probes``."""
        found = []
        for band, values in enumerate(self._projected(vector[None, :])[0]):
            own = int(((values > 0) * (1 << np.arange(self.bits))).sum())
            order = np.argsort(np.abs(values))[:10]
            cost = np.abs(values)[order]
            # Flips among the ten weakest bits, by the sum of what they cost.
            flips = np.arange(1 << len(order))
            chosen = (flips[:, None] >> np.arange(len(order))) & 1
            for flip in chosen[np.argsort(chosen @ cost, kind="stable")[:probes]]:
                found.append((band, own ^ int(sum(1 << int(b) for b in order[flip == 1]))))
        return found

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """``query, band, bucket`` for every song of ``queries``."""

        @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
        def looked(vectors: pa.Array) -> pa.Array:
            rows = _unit(_matrix(vectors)) if len(vectors) else []
            return pa.array([self.probe(row, probes) for row in rows], pa.list_(pa.list_(pa.int32())))

        pairs = _held(queries).select(F.col("song_id").alias("query"), F.explode(looked("embedding")).alias("p"))
        return pairs.select("query", F.col("p")[0].alias("band"), F.col("p")[1].alias("bucket"))


def write_buckets(buckets: DataFrame, path: str) -> None:
    """Stores an index: one folder per band, buckets sorted so that files are skipped."""
    buckets.repartitionByRange("band", "bucket").sortWithinPartitions("band", "bucket").write.partitionBy(
        "band"
    ).mode("overwrite").parquet(path)


def candidates(index: SignIndex, buckets: DataFrame, queries: DataFrame, probes: int = 64) -> DataFrame:
    """``query, song_id``: pairs that share a probed bucket, each once.

    One join on (band, bucket), whose hot buckets adaptive execution splits.
    """
    met = index.probed(queries, probes).join(buckets, ["band", "bucket"])
    return met.where(F.col("query") != F.col("song_id")).select("query", "song_id").distinct()


def ann_topk_all(
    index: SignIndex, buckets: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = 10, probes: int = 64
) -> DataFrame:
    """Approximate neighbours of every song of ``queries``: ``song_id, neighbour, dist, rank``.

    ``buckets`` is the stored table of ``index``. Only songs in a probed bucket compete;
    their distances are exact and equal ones rank by id. A query whose buckets hold fewer
    than ``k`` songs has fewer neighbours: ``probes`` is the knob.
    """
    met = candidates(index, buckets, queries, probes)
    asked = _held(queries).select(F.col("song_id").alias("query"), F.col("embedding").alias("_asked"))
    both = met.join(_held(embeddings), "song_id").join(asked, "query")

    @F.arrow_udf(T.DoubleType())
    def between(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], type=pa.float64())
        return pa.array(1.0 - (_unit(_matrix(a)) * _unit(_matrix(b))).sum(axis=1), type=pa.float64())

    dist = both.select(
        F.col("query").alias("song_id"), F.col("song_id").alias("neighbour"), between("embedding", "_asked").alias("dist")
    )
    return ranking.top_n_per(dist, ["song_id"], k, F.col("dist").asc_nulls_last(), F.col("neighbour"))


def ann_topk(
    index: SignIndex,
    buckets: DataFrame,
    embeddings: DataFrame,
    songs: DataFrame,
    song_id: int,
    k: int = 10,
    probes: int = 64,
) -> DataFrame:
    """Approximate form of ``cosine_topk``: only songs in a probed bucket compete.

    The probed buckets are a list of ``bands * probes`` pairs, small whatever the table
    holds; the index is narrow, and vectors are read for the songs met.
    """
    vector = vector_of(embeddings, song_id)
    if vector is None:
        return cosine_topk(embeddings, songs, song_id, k)
    spark = embeddings.sparkSession
    looked = spark.createDataFrame(index.probe(vector, probes), "band int, bucket int")
    met = buckets.join(F.broadcast(looked), ["band", "bucket"]).where(F.col("song_id") != song_id)
    met = met.select("song_id").distinct()
    near = _held(embeddings).join(met, "song_id", "left_semi")
    return _titled(near.select("song_id", _distance(vector)("embedding").alias("dist")), songs, k)
