import datetime as dt
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from upswell.operators import similarity
from upswell.plans import embed_run
from upswell.plans.calls import ServiceUnavailable
from upswell.sources import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "song_id bigint, embedding array<float>")


def titles(spark, ids):
    return spark.createDataFrame([(i, f"s{i}") for i in ids], "id bigint, title string")


def test_topk(spark):
    emb = vectors(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])])
    songs = titles(spark, range(1, 6))
    near = similarity.cosine_topk(emb, songs, 1).collect()
    assert [r.song_id for r in near] == [5, 2, 3, 4] and near[0].title == "s5"
    assert near[0].dist == pytest.approx(0) and near[2].dist == pytest.approx(1) and np.isnan(near[3].dist)
    assert [r.song_id for r in similarity.cosine_topk(emb, songs, 1, 2).collect()] == [5, 2]
    assert similarity.cosine_topk(emb, songs, 77).collect() == []


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_all_pairs_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5)).astype(np.float32)
    m[10] = m[11] = m[12]  # copies: equal distances rank by id
    m[20] = 0
    emb = vectors(spark, [(i, m[i].tolist()) for i in range(60)])
    found = {}
    for r in similarity.cosine_topk_all(emb, 4, block_rows).orderBy("song_id", "rank").collect():
        found.setdefault(r.song_id, []).append(r.neighbour)
    d = m.astype(np.float64)
    with np.errstate(invalid="ignore"):
        u = d / np.linalg.norm(d, axis=1, keepdims=True)
    dist = np.round(1 - u @ u.T, 12)
    for i in range(60):
        others = [j for j in range(60) if j != i]
        others.sort(key=lambda j: (np.isnan(dist[i, j]), 0 if np.isnan(dist[i, j]) else dist[i, j], j))
        assert found[i] == others[:4], i


def clustered(n, clusters, size, spread=0.15):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(clusters, size))
    return (centres[np.arange(n) % clusters] + spread * rng.normal(size=(n, size))).astype(np.float32)


def test_all_pairs_skips_far_cells(spark):
    """On clustered vectors under a third of the products are made, and nothing is missed."""
    m = clustered(1500, 30, 16)
    emb = vectors(spark, [(i, m[i].tolist()) for i in range(1500)]).repartition(4).cache()
    cells = similarity.Cells(emb, 50)
    known = similarity.bounded(cells, 10)
    blocks = {(r.cell, r.part): r["count"] for r in cells.placed.groupBy("cell", "part").count().collect()}
    asked = similarity.block_questions(cells, known).groupBy("cell", "part").count().collect()
    products = sum(n * n for n in blocks.values()) + sum(r["count"] * blocks[r.cell, r.part] for r in asked)
    assert sum(blocks.values()) == 1500 and products <= 0.3 * 1500 * 1500, products
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    dist = np.round(1 - u @ u.T, 12)
    np.fill_diagonal(dist, 9)
    expected = {i: np.lexsort((np.arange(1500), dist[i]))[:10].tolist() for i in range(1500)}
    found = {}
    for r in similarity.cosine_topk_all(emb, 10, 50).orderBy("song_id", "rank").collect():
        found.setdefault(r.song_id, []).append(r.neighbour)
    assert found == expected


def test_all_pairs_in_a_crowded_cell(spark):
    """A third of all vectors in one place: the cell has several parts."""
    m = clustered(300, 6, 8)
    m[:100] = m[0]
    emb = vectors(spark, [(i, m[i].tolist()) for i in range(300)])
    cells = similarity.Cells(emb, 20)
    assert max(cells.parts.values()) >= 5 and len(cells.parts) > 5
    found = {}
    for r in similarity.cosine_topk_all(emb, 3, 20).orderBy("song_id", "rank").collect():
        found.setdefault(r.song_id, []).append(r.neighbour)
    assert found[50] == [0, 1, 2] and found[0] == [1, 2, 3] and len(found) == 300


def embeddings_at(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("song_id"), "embedding")


def neighbours(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.song_id, set()).add(r.neighbour)
    return out


def test_ann_recall_and_share(spark):
    emb = embeddings_at(spark, "sf0.1").cache()
    index = similarity.SignIndex(64)
    buckets = index.buckets(emb).cache()
    queries = emb.where("song_id % 50 = 0")
    exact = neighbours(similarity.cosine_topk_all(emb))

    def measured(probes):
        near = neighbours(similarity.ann_topk_all(index, buckets, emb, queries, probes=probes))
        recall = sum(len(exact[q] & near.get(q, set())) for q in range(0, 2000, 50)) / 400
        share = similarity.candidates(index, buckets, queries, probes).count() / (40 * 2000)
        return recall, share

    # Noise without structure: the worst case for any index.
    recall, share = measured(32)
    assert recall >= 0.6 and share <= 0.2
    recall, share = measured(128)
    assert recall >= 0.9 and share <= 0.4


def test_ann_on_structured_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    m = (centres[np.arange(800) % 40] + 0.3 * rng.normal(size=(800, 32))).astype(np.float32)
    emb = vectors(spark, [(i, m[i].tolist()) for i in range(800)]).cache()
    index = similarity.SignIndex(32, bands=16)
    buckets = index.buckets(emb).cache()
    queries = emb.where("song_id % 50 = 0")
    exact = neighbours(similarity.cosine_topk_all(emb).where("song_id % 50 = 0"))
    near = neighbours(similarity.ann_topk_all(index, buckets, emb, queries, probes=16))
    assert sum(len(exact[q] & near[q]) for q in exact) >= 0.9 * 10 * len(exact)
    assert similarity.candidates(index, buckets, queries, 16).count() <= 0.2 * 16 * 800


def test_ann_single_query(spark, tmp_path):
    emb = embeddings_at(spark, "sf0.001")
    songs = emb.select(F.col("song_id").alias("id"), F.lit("t").alias("title"))
    index = similarity.SignIndex(64)
    similarity.write_buckets(index.buckets(emb), str(tmp_path / "index"))
    buckets = spark.read.parquet(str(tmp_path / "index"))
    batch = neighbours(similarity.ann_topk_all(index, buckets, emb, emb.where("song_id = 123")))
    one = similarity.ann_topk(index, buckets, emb, songs, 123).collect()
    assert {r.song_id for r in one} == batch[123] and one == sorted(one, key=lambda r: r.dist)
    assert similarity.ann_topk(index, buckets, emb, songs, -1).collect() == []


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], [(1, [1.0, 2.0]), (2, [None, 1.0])]])
def test_vectors_of_other_sizes_are_refused(spark, rows):
    emb = vectors(spark, [*rows, (3, [0.5, 0.5])]).coalesce(1)
    with pytest.raises(Exception, match="one size|NULL value"):
        similarity.cosine_topk_all(emb).collect()
    with pytest.raises(Exception, match="one size|NULL value"):
        similarity.cosine_topk(emb, titles(spark, [1, 2]), 3).collect()


def test_missing_vectors_are_left_out(spark):
    emb = vectors(spark, [(1, [1.0, 2.0]), (2, None), (3, [3.0, 4.0])])
    assert [r.song_id for r in similarity.cosine_topk(emb, titles(spark, [1, 2, 3]), 1).collect()] == [3]
    assert similarity.cosine_topk(emb, titles(spark, [1, 2, 3]), 2).collect() == []


def test_source_rows_and_stale(spark):
    songs = spark.createDataFrame([(1, "a", "Original"), (2, "b", None)], "id bigint, title string, song_type string")
    artists = spark.createDataFrame([(1, "z"), (2, "y"), (3, "y")], "id bigint, name string")
    song_artists = spark.createDataFrame([(1, 1, ""), (1, 2, ""), (1, 3, "m")], "song_id bigint, artist_id bigint, role string")
    tags = spark.createDataFrame(
        [(1, "raw", "Rock", "canon_lite"), (2, "other", "Rock", "canon_flash"), (3, "kept", "Pop", "pending")],
        "id bigint, name string, canon_name string, canon_status string",
    )
    song_tags = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "song_id bigint, tag_id bigint")
    rows = similarity.source_rows(songs, song_artists, artists, song_tags, tags)
    found = {r.song_id: (r.artists, r.tags) for r in rows.collect()}
    assert found == {1: (["y", "z"], ["Rock", "kept"]), 2: ([], [])}
    text = "a\ntype: Original\nartists: y, z\ntags: Rock, kept"
    for stored, stale in [
        ((1, text, "m"), [2]), ((1, text + "!", "m"), [1, 2]), ((1, text, "old"), [1, 2]), ((9, text, "m"), [1, 2]), ((1, None, "m"), [1, 2])
    ]:
        known = spark.createDataFrame([stored], "song_id bigint, source_text string, model string")
        assert sorted(r.song_id for r in similarity.select_stale(rows, known, "m").collect()) == stale


def test_parse_vectors(spark):
    def answer(*items):
        return json.dumps({"data": [{"index": i, "embedding": v} for i, v in items]})

    cases = [
        (0, 2, answer((1, [2.0]), (0, [1.0]))), (1, 2, answer((0, [1.0]))), (2, 2, answer((0, [1.0]), (0, [2.0]))),
        (3, 1, answer((0, "x"))), (4, 2, answer((0, [1.0]), (2, [2.0]))), (5, 1, "{}"), (6, 1, None), (7, 1, "broken"),
        (8, 1, '{"data": [3]}'),
    ]
    found = similarity.parse_vectors(spark.createDataFrame(cases, "batch_no bigint, n int, raw string"))
    assert [tuple(r) for r in found.orderBy("index").collect()] == [(0, 0, [1.0]), (0, 1, [2.0])]


def embed(texts):
    if any("down" in t for t in texts):
        raise ServiceUnavailable
    if any("odd" in t for t in texts):
        return answer_for(texts[1:])
    return answer_for(texts)


def answer_for(texts):
    return json.dumps({"data": [{"index": i, "embedding": [len(t)]} for i, t in enumerate(texts)][::-1]})


def to_embed(spark, titles):
    none = "cast(array() as array<string>) as artists", "cast(array() as array<string>) as tags"
    return spark.createDataFrame(list(enumerate(titles)), "song_id bigint, title string").selectExpr(
        "song_id", "title", "cast(null as string) as song_type", *none
    ).repartition(1)


EMBEDDED = "song_id bigint, embedding array<float>, source_text string, model string, updated_at timestamp"
AT = dt.datetime(2026, 7, 20)


def test_run_embed_resumes(spark):
    rows = to_embed(spark, [f"t{i}" for i in range(9)] + ["down"])
    stored = spark.createDataFrame([], EMBEDDED)
    table, summary = embed_run.run_embed(rows, stored, embed, "m", F.lit(AT), size=2, calls_at_once=1)
    # After the outage the task calls no more; what came before is kept.
    found = summary.first()
    assert (found.songs, found.stale) == (10, 10) and found.embedded % 2 == 0 and found.embedded < 10
    again, summary = embed_run.run_embed(rows.where("title <> 'down'"), table, embed, "m", F.lit(AT), size=1, calls_at_once=1)
    assert again.count() == 9 and summary.first().stale == 9 - found.embedded
    assert embed_run.run_embed(rows, again, embed, "m2", F.lit(AT))[1].first().stale == 10


def test_a_reply_with_other_indexes_counts_for_nothing(spark):
    rows = to_embed(spark, ["a", "odd", "b", "c"])
    table, summary = embed_run.run_embed(rows, spark.createDataFrame([], EMBEDDED), embed, "m", F.lit(AT), size=2, calls_at_once=1)
    assert summary.first().embedded == 2 and table.where("source_text like '%odd%'").count() == 0
    for r in table.collect():
        assert r.embedding == [len(r.source_text)]


def test_other_errors_are_not_hidden(spark):
    rows = to_embed(spark, ["a"])
    with pytest.raises(Exception, match="division"):
        embed_run.run_embed(rows, spark.createDataFrame([], EMBEDDED), lambda texts: 1 / 0, "m", F.lit(AT))


def test_waves_are_stored_one_by_one(spark, tmp_path):
    root = str(tmp_path / "db")
    tables.create_tables(spark, root)
    songs = spark.range(20).selectExpr("id", "concat('t', id) as title")
    for f in tables.TABLES["songs"]:
        if f.name not in songs.columns:
            songs = songs.withColumn(f.name, F.lit(None).cast(f.dataType))
    tables.write_table(songs, root, "songs")
    calls = spark.sparkContext.accumulator(0)

    def fails_later(texts):
        calls.add(1)
        if "t13" in texts[0]:
            raise ZeroDivisionError("killed")
        return answer_for(texts)

    with pytest.raises(Exception, match="killed"):
        embed_run.refresh_embeddings(spark, root, fails_later, "m", F.lit(AT), size=1, wave_texts=4)
    kept = tables.scan(spark, root, "song_embeddings").count()
    assert 0 < kept < 20
    done = embed_run.refresh_embeddings(spark, root, answer_for, "m", F.lit(AT), vector_size=1)
    assert done == {"songs": 20, "stale": 20 - kept, "embedded": 20 - kept}
    with pytest.raises(Exception, match="vector of 1 values"):
        embed_run.refresh_embeddings(spark, root, answer_for, "m2", F.lit(AT), vector_size=2)
