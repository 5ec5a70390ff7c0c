"""Spelling variants against words compared by what is left when a letter goes."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from upswell.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near_words(counts):
    """word to its near words, by patterns with one place left open or taken out."""
    met, near = {}, {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            met.setdefault((w[:i], w[i + 1 :]), []).append(w)
    for same in met.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    for w in counts:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in counts and short != w:
                near[w].add(short)
                near[short].add(w)
    return near


def by_hand(counts, factor=10):
    near, forms = near_words(counts), {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, counts[w], len(near[w]), counts[forms[w]] if forms[w] else None)
    return out


def found(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lower, counts = {c: c + 32 for c in range(65, 91)}, Counter()
    for doc in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", doc.text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    assert found(queries.QUERIES["op12_spelling_variants"](spark, SF)) == by_hand(counts)


@pytest.mark.parametrize("cell_words", [40, 1 << 17])
def test_crowds_and_chains(spark, cell_words):
    """Anagrams, which no cut by counts can part, chains of forms, and words of many lengths."""
    draw = np.random.default_rng(cell_words)
    words = {"".join(draw.permutation(list("abcdefg"))): int(draw.integers(2, 400)) for _ in range(400)}
    words |= {"".join(draw.choice(list("abà😀"), size=int(draw.integers(1, 9)))): int(draw.integers(2, 400)) for _ in range(400)}
    words |= {"waterfall": 10_000, "waterfal": 1000, "waterfl": 90, "wterfl": 5, "x" * 300: 700, "x" * 301: 5, "x" * 299 + "y": 6, "y" * 70_000: 2}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = found(spelling.variants(frame, cell_words=cell_words))
    assert got == by_hand(words)
    assert got["waterfl"][:2] == ("waterfal", "waterfall")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=3), min_size=1, max_size=30, unique=True), st.lists(st.text("abc", min_size=2, max_size=3), max_size=30, unique=True))
def test_tree_and_order(points, questions):
    """The tree gives all pairs at the distance, and the order checks agree with edits."""
    codes = spelling._codes(points, 3)
    for kind in (0, 1):
        asked = [q for q in questions if len(q) == 3 - kind]
        if not asked:
            continue
        letters = np.unique(np.concatenate([codes.ravel(), spelling._codes(asked, 3 - kind).ravel()]))
        counts, theirs = spelling._counted(codes, letters), spelling._counted(spelling._codes(asked, 3 - kind), letters)
        most = np.maximum(counts.max(axis=0), theirs.max(axis=0))
        tree = spelling._Tree(counts, spelling._unary(counts, most))
        pairs = {(int(q), int(w)) for qs, ws in tree.in_range(spelling._unary(theirs, most), 1, 1 - kind) for q, w in zip(qs, ws)}
        assert pairs == {(i, j) for i in range(len(asked)) for j in range(len(points)) if abs(theirs[i].astype(int) - counts[j]).sum() == 2 - kind}
        for i, j in pairs:
            q, w = asked[i], points[j]
            edits = sum(a != b for a, b in zip(q, w)) == 1 if not kind else q in {w[:k] + w[k + 1 :] for k in range(3)}
            fits = (spelling._one_inserted if kind else spelling._one_replaced)(spelling._codes([q], 3 - kind), codes[[j]])
            assert bool(fits[0]) == edits


def test_cells_cover_every_range():
    """A word's range meets the cell of every word one edit away."""
    draw = np.random.default_rng(3)
    words = sorted({"".join(draw.choice(list("abcdefgh"), size=8)) for _ in range(3000)})
    codes = spelling._codes(words, 8)
    tree = spelling._cut(codes, [0])
    home = {words[i]: cell for cell, rows in spelling._cells(tree, codes, 0, 0) for i in rows}
    asks = {}
    for cell, rows in spelling._cells(tree, codes, 1, 1):
        for i in rows:
            asks.setdefault(words[i], set()).add(cell)
    assert len(home) == len(words) and len(set(home.values())) > 20
    for word, others in near_words(dict.fromkeys(words, 1)).items():
        assert {home[o] for o in others if len(o) == 8} <= asks[word]
    assert np.mean([len(a) for a in asks.values()]) < 0.8 * len(set(home.values()))


def test_nulls_and_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(spelling.word_counts(spelling.runs(none, 7).withColumnRenamed("run", "word"))).collect() == []
    docs = spark.createDataFrame([(1, None), (None, "Ünïque WORDING wording"), (3, ""), (3, "wordings wordings")], "doc_id bigint, text string")
    runs = spelling.runs(docs.withColumn("word", docs.text).withColumn("n", docs.doc_id), 7)
    assert sorted(r.run for r in runs.collect()) == ["wording", "wording", "wordings", "wordings"]
    counted = spelling.word_counts(runs.withColumnRenamed("run", "word"))
    assert found(spelling.variants(counted)) == {"wording": (None, "wording", 2, 1, None), "wordings": (None, "wordings", 2, 1, None)}
    # A NULL id damages nothing.
    nulls = runs.where("doc_id is null").select(spelling.damaged(runs.run, runs.doc_id, every=1).alias("word"))
    assert {r.word for r in nulls.collect()} == {"wording"}
