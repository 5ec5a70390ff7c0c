"""Operators without SQL against plain loops over the same rows."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from upswell.llm import components, decontaminate, mixing, quality, queries, repeats, sharding, simhash, suffixes

SF = "/root/testdata/sf0.001"


def texts(spark, folder=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order(symbols):
    found = suffixes.suffix_order(np.array(symbols, np.int64))
    assert list(found) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def removed(documents):
    """doc_id to (bytes, mask of removed ones)."""
    first = {}
    for i in sorted(documents):
        data = documents[i].encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    out = {}
    for i, text in documents.items():
        data = text.encode()
        mask = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                mask[k : k + 50] = b"\1" * 50
        out[i] = data, mask
    return out


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 50_000, "shard_bytes": 40_000, "sort_bytes": 10_000}])
def test_repeats(spark, sizes):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in repeats.repeated_spans(frame, **sizes).collect()}
    for i, (data, mask) in removed(texts(spark)).items():
        spans = [m.span() for m in re.finditer(b"\1+", bytes(mask))]
        kept = bytes(b for b, m in zip(data, mask) if not m)
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), sum(mask), len(spans)), i
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and [tuple(s) for s in r.spans] == spans


def test_repeats_of_periodic_and_hot_text(spark):
    line = "This very line is shared by a great many of all the documents here. "
    documents = {i: line + f"{i} " * (i % 7) + line * (i % 3) for i in range(300)}
    documents |= {300 + i: "ab" * (20 + i) for i in range(20)} | {400: "", 401: "x" * 49, 402: "x" * 50, 403: "x" * 51}
    frame = spark.createDataFrame(list(documents.items()), "doc_id bigint, text string").repartition(6)
    found = {r.doc_id: r for r in repeats.repeated_spans(frame, batch_bytes=3000, shard_bytes=4000, sort_bytes=500).collect()}
    for i, (data, mask) in removed(documents).items():
        assert found[i].n_removed == sum(mask), i


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(prints, most):
    """The least id reachable through prints within ``most`` bits."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    prints = {i: fingerprint(t) for i, t in texts(spark).items()}
    groups = joined(prints, 2)
    for r in queries.QUERIES["op7_simhash"](spark, SF).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", groups[r.doc_id])


@pytest.mark.parametrize("crowd", [0, 3, 64])
@pytest.mark.parametrize("most", [0, 1, 2])
def test_links_in_crowds(spark, monkeypatch, crowd, most):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = np.random.default_rng(crowd + most)
    # Values that differ in a few of eight bits, over both halves and the sign bit.
    places = [0, 1, 2, 31, 32, 33, 62, 63]
    prints = {sum(1 << places[b] for b in range(8) if draw.integers(4) == 0) ^ (int(c) << 10) for c in range(3) for _ in range(25)}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    roots = {r.node: r.root for r in components.components(simhash.links(frame, most)).collect()}
    expected = joined({s: p for s, p in signed.items()}, most)
    assert {s: roots.get(s, s) for s in signed} == expected


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    found = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.node: r.root for r in found} == {**{i: 0 for i in range(1, 101)}, **{i: 1000 for i in range(1001, 1100)}}


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    grades = quality.graded(spark.read.parquet(f"{folder}/labels.parquet")).cache()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, grades.where(~held))
    rated = quality.rate(docs.join(grades.where(held), "doc_id"), model).cache()
    kept = {r.grade: r.share for r in rated.groupBy("grade").agg(F.avg(quality.selected().cast("int")).alias("share")).collect()}
    # A quarter of the toxic labels stand on texts without any toxic word.
    assert kept[2] >= 0.97 and kept[1] <= 0.15 and kept[0] <= 0.4
    mean = {r.grade: r.m for r in rated.groupBy("grade").agg(F.avg("expected_grade").alias("m")).collect()}
    assert mean[0] < mean[2] and mean[1] < mean[2]
    again = quality.train(docs.repartition(7), grades.where(~held))
    assert np.array_equal(again.weights, model.weights)


def test_tails_are_ordered():
    model = quality.OrdinalModel(np.zeros(quality.BUCKETS), np.array([-1.0, 2.0]))
    above = model.above(np.linspace(-5, 5, 11))
    assert (np.diff(above, axis=0) > 0).all() and (above[:, 0] > above[:, 1]).all()


def test_mix_takes_a_prefix_of_finish_times(spark):
    """Weighted fair queueing by hand, from the sizes and order the operator gives."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    found = mixing.mix(frame).join(frame.select("doc_id", "source"), "doc_id").collect()
    order = sorted(found, key=lambda r: hashlib.md5(f"0:{r.doc_key}".encode()).hexdigest())
    until, copies = {}, []
    for r in order:
        until[r.source] = until.get(r.source, 0) + r.size
        for turn in (0, 1):
            copies.append(((until[r.source] + turn * r.source_size) / r.target, hashlib.md5(f"0:{r.doc_key}".encode()).hexdigest(), turn, r))
    total, taken = 0, {}
    for _, _, _, r in sorted(copies, key=lambda c: c[:3]):
        total += r.size
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.size * (total <= 1.5 * sum(x.size for x in found))
    assert {r.doc_id: r.taken for r in found} == taken


def test_shards_by_hand(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.QUERIES["op10_shards"](spark, SF).collect()
    own = texts(spark)
    assert sorted(r.doc_id for r in found) == sorted(own)
    for r in found:
        data = own[r.doc_id].encode()
        assert r["size"] == len(data) + 8 and r.text_crc32 == __import__("zlib").crc32(data)
        assert r.law == "rows" and r.grown_shard is None
    counts = np.bincount([r.shard for r in found], minlength=24)
    assert counts.max() - counts.min() <= 1 and frame.count() == counts.sum()
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(counts[s])) for s in range(24))


def test_pipeline(spark):
    """Every stage by its own rule on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality_classifier(spark, docs, SF).cache()
    model = quality.train(docs, quality.graded(labels))
    tails = {i: model.above(np.array([model.score(quality.features(t.encode()))]))[0, -1] for i, t in texts(spark).items()}
    assert {r.doc_id for r in good.collect()} == {i for i, t in tails.items() if t >= 0.5}
    single = corpus_pipeline.simhash_near_dedup(spark, good, SF).cache()
    prints = joined({r.doc_id: fingerprint(r.text or "") for r in good.collect()}, 2)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(prints.values()))
    clean = corpus_pipeline.benchmark_decontamination(spark, single, SF).cache()
    bench = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wins = {tuple(w[i : i + 13]) for w in bench for i in range(max(1, len(w) - 12)) if w}

    def hit(text):
        words = decontaminate.normalised(text)
        inside = {j for n in {len(w) for w in wins} for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in wins for j in range(i, i + n)}
        return bool(inside) and 20 * len(inside) >= len(words)

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not hit(r.text)}
    mixed = corpus_pipeline.mix_to_weights(spark, clean, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies and r["size"]}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    assert good.columns == single.columns == clean.columns == mixed.columns == columns
    last = corpus_pipeline.shuffle_into_shards(spark, mixed, SF).cache()
    assert last.columns == [*columns, "shard", "slot"] and last.count() == mixed.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last.collect()))


@pytest.mark.parametrize("hashes", ["own", "clashing"])
def test_hot_passage_is_sorted_in_parts(monkeypatch, hashes):
    """The ends of a shared passage are a different segment in every document, under one key."""
    if hashes == "clashing":
        plain = repeats._window_hashes
        monkeypatch.setattr(repeats, "_window_hashes", lambda eight, at: plain(eight, at) & np.uint64(0xFFF0000000000000))
    sorted_bytes = []

    def first_owner(strings, owners, length):
        sorted_bytes.append(sum(map(len, strings)))
        return suffixes.first_owner(strings, owners, length)

    monkeypatch.setattr(repeats, "first_owner", first_owner)
    draw, limit, shards = np.random.default_rng(5), 8000, 4
    passage = "One passage that a great many of the documents have in the middle of their own text. "

    def own():
        return "".join(chr(97 + c) for c in draw.integers(0, 26, 40))

    documents = {i: own() + passage + own() for i in range(600)}
    documents |= {600 + i: documents[i] for i in range(0, 600, 9)}
    packed = []
    for nth in range(6):
        ids = [i for i in documents if i % 6 == nth]
        data = [documents[i].encode() for i in ids]
        sizes = np.array([len(d) for d in data], np.int64)
        packed.append({"batch": nth, "ids": np.array(ids, np.int64).tobytes(), "sizes": sizes.tobytes(), "text": repeats._squeeze(b"".join(data))})

    def by(tables, column):
        whole = pa.concat_tables(tables)
        return [whole.filter(pc.equal(whole[column], v)) for v in whole[column].unique()]

    def batch(answers, nth):
        return answers.filter(pc.equal(answers["batch"], nth))

    offers = [pa.Table.from_batches([b]) for b in repeats._offers(shards)([pa.RecordBatch.from_pylist(packed)])]
    first = pa.concat_tables([repeats._answer_offers(limit)(t) for t in by(offers, "shard")])
    sent = [repeats._send(shards)(pa.Table.from_pylist([row]), batch(first, row["batch"])) for row in packed]
    second = pa.concat_tables([first, *[repeats._sort(limit)(t) for t in by(sent, "shard")]])
    found = {}
    for row in packed:
        cut = repeats._cut(shards)(pa.Table.from_pylist([row]), batch(second, row["batch"]))
        found |= {r["doc_id"]: r["spans"] for r in cut.to_pylist()}
    for i, (_, mask) in removed(documents).items():
        assert [tuple(s) for s in found[i]] == [m.span() for m in re.finditer(b"\1+", bytes(mask))], i
    # Few different hashes deal out badly, but right.
    assert hashes == "clashing" or max(sorted_bytes) < 3 * limit


def test_a_batch_is_ordered_by_shard_once():
    """What a batch does for its answers does not grow with the number of shards."""
    draw, took = np.random.default_rng(8), {}
    texts_ = [draw.integers(97, 123, 4000, np.uint8).tobytes() for _ in range(500)]
    packed = {
        "batch": 0,
        "ids": np.arange(500).tobytes(),
        "sizes": np.array([len(t) for t in texts_], np.int64).tobytes(),
        "text": repeats._squeeze(b"".join(texts_)),
    }
    for shards in (16, 9600):
        batch = repeats.Batch(packed["ids"], packed["sizes"], packed["text"])
        keys, _, _ = batch.distinct()
        counts = np.bincount(keys % np.uint64(shards), minlength=shards)
        bits = [np.packbits(np.zeros(n, bool)).tobytes() for n in counts]
        answers = pa.table({"batch": [0] * shards, "kind": [repeats._SHARED] * shards, "shard": list(range(shards)), "bits": bits})
        batch.shared(shards, answers)
        start = time.perf_counter()
        batch.shared(shards, answers)
        took[shards] = time.perf_counter() - start
    assert took[9600] < 2 * took[16] + 0.2, took
