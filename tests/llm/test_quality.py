"""The ordinal classifier against plain loops: features, likelihood, training steps and scores."""

import math

import numpy as np
import pytest

from upswell.llm import quality, queries

SF = "/root/testdata/sf0.001"
WIDE = (1 << 64) - 1


def word_hash(codes):
    total = 0
    for place, code in enumerate(codes):
        part = ((code + 1) * int(quality._PLACES[place % 64]) + place) & WIDE
        part ^= part >> 29
        total = (total + part * 0x9E3779B97F4A7C15) & WIDE
    return total


def mixed(value):
    value ^= value >> 31
    return value * 0x94D049BB133111EB & WIDE


def runs(codes):
    out, own = [], []
    for code in [*codes, 0]:
        if code:
            own.append(code)
        elif own:
            out.append(own)
            own = []
    return out


def plain_features(text):
    words = [word_hash([int(c) for c in r]) for r in runs(int(quality._letters[b]) for b in text)]
    kinds, last = [], None
    for b in text:
        kind = int(quality._shapes[b])
        if kind != last:
            kinds.append(kind)
        last = kind
    shapes = [word_hash(r) for r in runs(kinds)]
    counts = {}
    for s in shapes:
        counts[s] = counts.get(s, 0) + 1
    counts_again = sum(a == b for a, b in zip(words, words[1:]))
    total = max(1, len(shapes))
    found = set(words)
    for kind, n in [*counts.items(), (1, counts_again)]:
        found |= {mixed((kind + k + 1) & WIDE) for k in range(6) if n * (1 << k) >= total}
    shift = 65 - quality.BUCKETS.bit_length()
    return sorted({mixed(f) >> shift for f in found})


@pytest.mark.parametrize("text", ["", "One two TWO two!", "THE!! ENTIRE!! day 123 a1b2", "größe ñ 漢字 \n\t x", "word " * 50, "..., ;;"])
def test_features(text):
    data = text.encode()
    expected = plain_features(data) if data else []
    assert quality.features(data).tolist() == expected


def logistic(x):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def loss(weights, cut, rows, grades, decay):
    """Mean negative log-likelihood of the grades, with weight decay."""
    thresholds = [cut[0], cut[0] + math.exp(cut[1])]
    total = 0.0
    for row, grade in zip(rows, grades):
        score = sum(weights[b] for b in row)
        upper = logistic(thresholds[grade] - score) if grade < 2 else 1.0
        lower = logistic(thresholds[grade - 1] - score) if grade else 0.0
        total -= math.log(max(upper - lower, 1e-12))
    return total / len(rows) + decay / (2 * len(rows)) * sum(w * w for w in weights.values())


def test_training_steps_by_differences():
    """The same steps with gradients taken from differences of the plain loss."""
    draw = np.random.default_rng(2)
    rows = [sorted({int(b) for b in draw.integers(0, 6, 4)} | {7 + i % 2}) for i in range(24)]
    grades = [int(g) for g in draw.integers(0, 3, 24)]
    steps, decay = 25, 1.0
    model = quality.fit([np.array(r) for r in rows], np.array(grades), steps, decay)
    met = {b: sum(b in r for r in rows) for b in range(10)}
    rows = [[b for b in r if met[b] >= quality.LEAST_DOCS] for r in rows]
    names = sorted({b for r in rows for b in r})
    share = [min(0.99, max(0.01, sum(g <= j for g in grades) / 24)) for j in range(2)]
    start = [math.log(s / (1 - s)) for s in share]
    at = [0.0] * len(names) + [start[0], math.log(max(start[1] - start[0], 0.05))]
    first, second = [0.0] * len(at), [0.0] * len(at)

    def value(p):
        return loss(dict(zip(names, p)), p[len(names) :], rows, grades, decay)

    for step in range(1, steps + 1):
        gradient = []
        for i in range(len(at)):
            up, down = list(at), list(at)
            up[i] += 1e-6
            down[i] -= 1e-6
            gradient.append((value(up) - value(down)) / 2e-6)
        rate = 0.05 * min(1, 2 * (1 - step / (steps + 1)))
        for i, g in enumerate(gradient):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.001 * (g * g - second[i])
            at[i] -= rate * (first[i] / (1 - 0.9**step)) / (math.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(model.weights[names], at[: len(names)], atol=2e-3)
    assert np.allclose(model.thresholds, [at[-2], at[-2] + math.exp(at[-1])], atol=2e-3)
    assert np.count_nonzero(model.weights) <= len(names)


def test_query_by_hand(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, quality.graded(labels))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in queries.QUERIES["op8_ordinal_quality"](spark, SF).collect():
        score = sum(float(model.weights[b]) for b in (plain_features(texts[r.doc_id]) if texts[r.doc_id] else []))
        above = [1 - logistic(t - score) for t in model.thresholds]
        assert abs(r.tail - above[-1]) < 1e-3 and abs(r.expected_grade - sum(above)) < 1e-3
        assert r.kept == (r.tail >= 0.5)


def test_ties_in_the_sample_and_empty_tables(spark):
    """Which labels are used follows from the ids; no documents or no labels give a model all the same."""
    docs = spark.range(300).selectExpr("id as doc_id", "concat('word', id % 5, ' more text') as text")
    labels = spark.range(300).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    one = quality.train(docs, quality.graded(labels), sample=100)
    two = quality.train(docs.repartition(7), quality.graded(labels.repartition(3)), sample=100)
    assert (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()
    none = quality.train(docs.limit(0), quality.graded(labels))
    assert quality.rate(docs.limit(0), none).collect() == [] and not none.weights.any()
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
