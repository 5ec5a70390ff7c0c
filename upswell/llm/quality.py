"""Quality classifier: ordinal regression of grades on hashed text."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.llm.common import set_aside

#: Features are hashed into this many weights.
BUCKETS = 1 << 17
#: Labelled documents used for the fit, at most: the ones with the smallest seeded hashes.
SAMPLE = 8192
#: Buckets met in fewer documents of the sample keep weight 0.
LEAST_DOCS = 4
GRADES = 3
#: Bytes looked at together.
BLOCK_BYTES = 1 << 20

_letters = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    # Letters and digits stand for themselves (A-Z folded), the rest ends a word.
    _letters[_b] = _b + 32 if "A" <= _c <= "Z" else _b if _c.isascii() and _c.isalnum() or _b >= 128 else 0
_shapes = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    # Capitals, small letters and digits by kind, punctuation as it is, white space ends.
    _shapes[_b] = (
        0 if _b == 32 or 9 <= _b <= 13 else 65 if "A" <= _c <= "Z" else 97 if "a" <= _c <= "z" or _b >= 128
        else 48 if "0" <= _c <= "9" else _b
    )
#: An odd multiplier for each place in a word, repeated after a while.
_PLACES = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(codes: np.ndarray) -> np.ndarray:
    """The hash of each run of codes other than 0."""
    inside = codes != 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # A code's place counts from the start of its word.
    length = ends - starts
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, length)
    part = (codes[at].astype(np.uint64) + np.uint64(1)) * _PLACES[place % 64] + place.astype(np.uint64)
    part ^= part >> np.uint64(29)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return np.add.reduceat(part * np.uint64(0x9E3779B97F4A7C15), first)


def features(text: bytes) -> np.ndarray:
    """The distinct buckets of one text: folded words, and how common shapes and repeats are.

    A token's shape has its punctuation and the kinds of its other characters, runs of a
    kind once: THE!! and ENTIRE!! have the same shape. For a shape (and for words that
    repeat the word before) there is one feature for each power of 2 that its share of all
    tokens reaches, from 1/32 on, so that one odd token in a long text tells nothing.
    """
    words, shapes, again, last = [], [], 0, None
    for data in _blocks(text):
        found = _words(_letters[data])
        if len(found):
            again += np.count_nonzero(found[1:] == found[:-1]) + (found[0] == last)
            last = found[-1]
        words.append(np.unique(found))
        kinds = _shapes[data]
        repeated = np.concatenate(([False], kinds[1:] == kinds[:-1]))
        shapes.append(_words(kinds[~repeated]))
    if not words:
        return np.zeros(0, np.int64)
    kinds, counts = np.unique(np.concatenate(shapes), return_counts=True)
    kinds, counts = np.append(kinds, np.uint64(1)), np.append(counts, again)
    total = max(1, counts[:-1].sum())
    steps = [_mix(kinds[counts * (1 << k) >= total] + np.uint64(k + 1)) for k in range(6)]
    every = np.concatenate((*words, *steps))
    return np.unique(_mix(every) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def _mix(values: np.ndarray) -> np.ndarray:
    """Spreads the low bits of hashes over the high ones."""
    values = values ^ (values >> np.uint64(31))
    return values * np.uint64(0x94D049BB133111EB)


def _blocks(text: bytes) -> Iterator[np.ndarray]:
    """The bytes of a text, a long one in blocks cut at white space."""
    at = 0
    while at < len(text):
        end = min(at + BLOCK_BYTES, len(text))
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield np.frombuffer(text, np.uint8, end - at, at)
        at = end


class OrdinalModel:
    """Cumulative link: P(grade <= j) = s(threshold_j - x.w), s the logistic function."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for every j but the last, a row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -60, 60)))

    def score(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum())


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 200, decay: float = 1.0) -> OrdinalModel:
    """Maximum likelihood with weight decay by full-batch Adam steps.

    Weights are shared by all thresholds; thresholds stay in order as a first value and
    positive gaps. Of a document all distinct buckets count once.
    """
    size = np.array([len(r) for r in rows], np.int64)
    index = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    count = len(rows)
    known = np.bincount(index, minlength=BUCKETS)[index] >= LEAST_DOCS
    index, owner = index[known], owner[known]
    weights = np.zeros(BUCKETS)
    share = np.clip([np.mean(grades <= j) if count else (j + 1) / GRADES for j in range(GRADES - 1)], 0.01, 0.99)
    start = np.log(share / (1 - share))
    cut = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 0.05))))
    if not count:
        return OrdinalModel(weights, np.cumsum(np.concatenate((cut[:1], np.exp(cut[1:])))))
    parameters = np.concatenate((weights, cut))
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        weights, cut = parameters[:BUCKETS], parameters[BUCKETS:]
        gaps = np.exp(cut[1:])
        thresholds = np.cumsum(np.concatenate((cut[:1], gaps)))
        score = np.bincount(owner, weights[index], count)[:count]
        # P(grade) is the difference of two neighbouring cumulative values.
        edge = np.concatenate(([-np.inf], thresholds, [np.inf]))
        upper = 1 / (1 + np.exp(-np.clip(edge[grades + 1] - score, -60, 60)))
        lower = 1 / (1 + np.exp(-np.clip(edge[grades] - score, -60, 60)))
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        # Gradient of the mean negative log-likelihood.
        d_score = (d_upper - d_lower) / count
        d_threshold = np.zeros(GRADES - 1)
        for j in range(GRADES - 1):
            d_threshold[j] = (d_lower[grades == j + 1].sum() - d_upper[grades == j].sum()) / count
        d_cut = np.array([d_threshold.sum(), *(d_threshold[j:].sum() * gaps[j - 1] for j in range(1, GRADES - 1))])
        gradient = np.concatenate(
            (np.bincount(index, d_score[owner], BUCKETS) + decay / count * weights, d_cut)
        )
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        rate = 0.05 * min(1, 2 * (1 - step / (steps + 1)))
        parameters = parameters - rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8
        )
    cut = parameters[BUCKETS:]
    return OrdinalModel(
        parameters[:BUCKETS].astype(np.float32), np.cumsum(np.concatenate((cut[:1], np.exp(cut[1:]))))
    )


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels: 0 toxic, 1 of low quality, 2 good.

    Rows with a NULL are no label; a document labelled twice has its lowest grade.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    whole = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return whole.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, seed: int = 0) -> OrdinalModel:
    """A model from at most ``sample`` graded documents, chosen by a seeded hash of doc_id.

    Only their bucket numbers reach the driver, one row per label: of several rows with a
    doc_id, the least bucket list counts, folded in the map tasks. The sample of grades is
    small by its limit and so may be broadcast to the documents.
    """
    chosen = grades.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            found = [features(t or b"").astype("<i4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())],
                                             ["doc_id", "grade", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = joined.select("text", "doc_id", "grade").mapInArrow(
        extract, f"doc_id {kind}, grade int, buckets binary"
    )
    # A label counts once, however many rows have its doc_id.
    found = found.groupBy("doc_id", "grade").agg(F.min("buckets").alias("buckets"))
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    return fit(
        [np.frombuffer(r["buckets"], "<i4") for r in rows], np.array([r["grade"] for r in rows], np.int64)
    )


def rate(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with expected_grade and tail, the probability of the best grade.

    Whole texts are scored where they are, no shuffle. NULL and empty texts have the grade
    that the thresholds alone give. All columns stay; expected_grade and tail replace
    columns of these names.
    """
    kept = docs.drop("expected_grade", "tail")
    schema = T.StructType(
        [
            *kept.schema.fields,
            T.StructField("expected_grade", T.DoubleType()),
            T.StructField("tail", T.DoubleType()),
        ]
    )
    weights, thresholds = model.weights, model.thresholds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = OrdinalModel(weights, thresholds)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            above = judge.above(np.array([judge.score(features(t or b"")) for t in texts], float))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(above.sum(axis=1)), pa.array(above[:, -1])],
                [*batch.schema.names, "expected_grade", "tail"],
            )

    return kept.mapInArrow(score, schema)


def selected(least_tail: float = 0.5) -> Column:
    return F.col("tail") >= least_tail


def keep_good(docs: DataFrame, labels: DataFrame, least_tail: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose best grade is likely enough."""
    model = train(docs, graded(labels), sample)
    aside, back = set_aside(docs, ["expected_grade", "tail"])
    good = rate(aside, model).where(selected(least_tail))
    return good.select(*back(good))
