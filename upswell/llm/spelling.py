"""Spelling variants: words one edit apart, found by k-d trees over their letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import ascii_lower
from upswell.session import materialize

#: Letters of a word: ASCII and Latin-1 ones.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Words that a leaf of a tree holds.
LEAF = 64
#: Questions that go down a tree together, and words of a leaf compared at once.
TOGETHER = 8192
#: Sampled words that a cell is cut from.
POINTS = 64
_MET = "word string, n_near bigint, best_n bigint, best string"


def runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run): every maximal run of ``least`` letters or more, A-Z lower-cased.

    NULL texts have none. A run may be as long as its text.
    """
    found = F.regexp_extract_all(F.col("text"), F.lit(LETTERS + f"{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", ascii_lower(F.col("run")).alias("run"))


def word_counts(words: DataFrame, least: int = 7, occurrences: int = 2) -> DataFrame:
    """(word, n): words of ``least`` code points and ``occurrences`` rows or more.

    Counts fold in the map tasks, so a word that makes a third of all rows moves once a task.
    """
    long = words.where(F.length("word") >= least)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def variants(counted: DataFrame, factor: int = 10, cell_words: int = 1 << 17) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a table of distinct (word, n).

    Two words are near if exactly one inserted, deleted or replaced code point separates
    them. n_near counts the near words. form is the near word of the largest n (of equal
    ones the first in code-point order) if that n is ``factor`` times the word's own or
    more, else NULL; root is where the forms end, the word itself if it has none.

    An edit changes letter counts by a distance of 2 at most: a replacement takes one
    letter and gives one, an insertion gives one. So words of one length are the points of
    k-d trees over their letter counts, and each word asks the trees of its own length and
    of the next one for the points of that small range. Boxes that the range misses are
    pruned; of the points in it the order of letters decides.

    The upper part of a tree cuts a length with over ``cell_words`` words into cells, fitted
    on one word in ``cell_words / 64``; every cell is one group of rows, its words and the
    questions whose range meets it, cut again where either are many (anagrams share all
    counts). The lower part is built in the task. Nothing is capped or left out.

    An empty table gives no rows; words that are NULL are left out.
    """
    words = materialize(counted.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    met = _near(words, cell_words)
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    found = met.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best").unionByName(every)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    judged = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    enough = -F.col("b.less") >= factor * F.col("n")
    formed = materialize(
        judged.select("word", "n", "n_near", F.when(enough, F.col("b.best")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n"))
    )
    ends = roots(formed.where(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of every chain of forms. Each round doubles the steps taken.

    ``forms`` has each word once and no circle: a form is always more frequent.
    """
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = now.join(ahead, F.col("root") == F.col("at"), "left")
        now = materialize(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return now.select("word", "root")


def _near(words: DataFrame, cell_words: int) -> DataFrame:
    """Rows of ``_MET``: what every block of words and questions found."""
    trees = _fit(words, cell_words)
    routed = materialize(words.mapInArrow(_route(trees), "length int, cell int, asks int, word string, n bigint"))
    is_word = F.col("asks") < 0
    sizes = routed.groupBy("length", "cell").agg(
        F.count(F.when(is_word, 1)).alias("words"), F.count(F.when(~is_word, 1)).alias("questions")
    )
    parts = sizes.where((F.col("words") > 0) & (F.col("questions") > 0)).select(
        "length",
        "cell",
        F.ceil(F.col("words") / (2 * cell_words)).alias("rows"),
        F.ceil(F.col("questions") / (2 * cell_words)).alias("columns"),
    )
    # Each block of words meets each block of questions of its cell.
    dealt = routed.join(materialize(parts), ["length", "cell"])
    own = lambda of: F.array(F.pmod(F.xxhash64("word"), F.col(of)))
    every = lambda of: F.sequence(F.lit(0).cast("long"), F.col(of) - 1)
    blocks = dealt.withColumn("row", F.explode(F.when(is_word, own("rows")).otherwise(every("rows")))).withColumn(
        "column", F.explode(F.when(is_word, every("columns")).otherwise(own("columns")))
    )
    blocks = blocks.select("length", "cell", "row", "column", "asks", "word", "n")
    return blocks.groupBy("length", "cell", "row", "column").applyInArrow(_search, _MET)


def _codes(words: list[str], length: int) -> np.ndarray:
    """One row of code points per word; all words have ``length`` of them."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


# ---- the upper tree: cells ------------------------------------------------------
def _fit(words: DataFrame, cell_words: int) -> dict[int, tuple]:
    """For every crowded length, a tree (letter, most, left, right) with cell numbers as leaves.

    The driver sees one word in ``cell_words / POINTS`` and no length of ``cell_words`` or fewer.
    """
    sized = words.select(F.length("word").alias("length"), "word")
    crowded = sized.groupBy("length").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > cell_words)
    some = sized.where(F.pmod(F.xxhash64(F.lit("cell"), "word"), F.lit(cell_words)) < POINTS)
    points: dict[int, list[str]] = {}
    for row in some.join(crowded, "length").select("length", "word").toLocalIterator():
        points.setdefault(row.length, []).append(row.word)
    return {length: _cut(_codes(sorted(some), length), [0]) for length, some in points.items()}


def _cut(codes: np.ndarray, cells: list[int]) -> tuple | int:
    if len(codes) > POINTS:
        letters = np.unique(codes)
        counts = np.stack([(codes == c).sum(axis=1) for c in letters], axis=1)
        for at in np.argsort(-counts.var(axis=0), kind="stable"):
            most = int(np.median(counts[:, at]))
            low = counts[:, at] <= most
            if low.all():
                most, low = most - 1, counts[:, at] < most
            if low.any() and not low.all():
                return int(letters[at]), most, _cut(codes[low], cells), _cut(codes[~low], cells)
    cells[0] += 1
    return cells[0] - 1


def _cells(tree: tuple | int, codes: np.ndarray, gains: int, loses: int) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, rows): which words' ranges meet the cell's box. No gain and loss: their own cells.

    A range is what up to ``gains`` more and ``loses`` fewer letters make of a word's counts.
    """
    todo = [(tree, np.arange(len(codes)), {}, np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64))]
    while todo:
        node, rows, box, lack, over = todo.pop()
        if isinstance(node, int):
            yield node, rows
            continue
        letter, most, left, right = node
        count = (codes[rows] == letter).sum(axis=1)
        low, high = box.get(letter, (0, None))
        for child, (lo, hi) in ((left, (low, most)), (right, (most + 1, high))):
            # A letter on the path counts once, with the box that the path has left of it.
            before = (np.maximum(low - count, 0), np.maximum(count - high, 0) if high is not None else 0)
            lacks = lack - before[0] + np.maximum(lo - count, 0)
            overs = over - before[1] + (np.maximum(count - hi, 0) if hi is not None else 0)
            ok = (lacks <= gains) & (overs <= loses)
            if ok.any():
                todo.append((child, rows[ok], {**box, letter: (lo, hi)}, lacks[ok], overs[ok]))


def _route(trees: dict[int, tuple]):
    """Every word as a point of its own cell, and as a question to all cells in its range.

    asks: -1 for a point, 0 for a question to words of the same length, 1 of the next length.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ns = batch["word"].to_pylist(), batch["n"]
            for length, rows in _by_length(words).items():
                codes = _codes([words[i] for i in rows], length)
                for asks, target, gains, loses in ((-1, length, 0, 0), (0, length, 1, 1), (1, length + 1, 1, 0)):
                    for cell, met in _cells(trees.get(target, 0), codes, gains, loses):
                        took = pa.array(rows[met])
                        fixed = [pa.array(np.full(len(met), x, np.int32)) for x in (target, cell, asks)]
                        columns = [*fixed, batch["word"].take(took), ns.take(took)]
                        yield pa.RecordBatch.from_arrays(columns, ["length", "cell", "asks", "word", "n"])

    return route


# ---- the lower tree: one block in a task ---------------------------------------
class _Tree:
    """A k-d tree over letter counts in unary: count c of a letter is c bits of its field.

    So the distance of two count vectors is the number of differing bits, and a box is what
    all words of a node have (``low``) and what any has (``high``).
    """

    def __init__(self, counts: np.ndarray, unary: np.ndarray):
        self.counts, self.unary = counts, unary
        self.root = self._node(np.arange(len(counts)))

    def _node(self, rows: np.ndarray) -> tuple:
        low = np.bitwise_and.reduce(self.unary[rows])
        high = np.bitwise_or.reduce(self.unary[rows])
        if len(rows) > LEAF:
            counts = self.counts[rows]
            spread = counts.astype(np.float32).var(axis=0)
            at = int(np.argmax(spread))
            if spread[at] > 0:
                middle = np.median(counts[:, at])
                left = counts[:, at] <= middle if (counts[:, at] > middle).any() else counts[:, at] < middle
                return low, high, None, (self._node(rows[left]), self._node(rows[~left]))
        return low, high, rows, ()

    def in_range(self, asked: np.ndarray, gains: int, loses: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(question, word) pairs exactly ``gains`` and ``loses`` letters apart."""
        todo = [(self.root, np.arange(len(asked)))]
        while todo:
            (low, high, rows, children), active = todo.pop()
            mine = asked[active]
            lack = np.bitwise_count(low & ~mine).sum(axis=1)
            over = np.bitwise_count(mine & ~high).sum(axis=1)
            active = active[(lack <= gains) & (over <= loses)]
            if not len(active):
                continue
            todo += [(child, active) for child in children]
            for at in range(0, 0 if rows is None else len(rows), LEAF):
                part, mine = rows[at : at + LEAF], asked[active]
                apart = np.bitwise_count(mine[:, None, 0] ^ self.unary[None, part, 0]).astype(np.uint16)
                for field in range(1, asked.shape[1]):
                    apart += np.bitwise_count(mine[:, None, field] ^ self.unary[None, part, field])
                question, word = np.nonzero(apart == gains + loses)
                if len(question):
                    yield active[question], part[word]


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether leaving one code point out of ``long`` gives ``short``: prefix and suffix meet."""
    size = short.shape[1]
    differs, shifted = short != long[:, :size], short != long[:, 1:]
    prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), size)
    suffix = np.where(shifted.any(axis=1), shifted[:, ::-1].argmax(axis=1), size)
    return prefix + suffix >= size


def _unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    bits = np.concatenate([counts[:, [j]] > np.arange(m) for j, m in enumerate(most)], axis=1)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def _counted(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(codes), len(letters)), np.uint8 if codes.shape[1] < 256 else np.int32)
    rows = np.arange(len(codes))
    for column in np.searchsorted(letters, codes).T:
        counts[rows, column] += 1
    return counts


def _search(block: pa.Table) -> pa.Table:
    """Near words of a block's questions among its words, and for those of the next length both ways."""
    asks = np.asarray(block["asks"])
    words, ns = np.array(block["word"].to_pylist(), object), np.asarray(block["n"])
    length = block["length"][0].as_py()
    # The order in which a near word becomes the form: frequent first, then by code point.
    order = np.argsort(words, kind="stable")
    order = order[np.argsort(-ns[order], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)

    points = np.flatnonzero(asks < 0)
    codes = _codes(list(words[points]), length) if len(points) else np.zeros((0, length), np.uint32)
    sides = {kind: np.flatnonzero(asks == kind) for kind in (0, 1)}
    asked = {kind: _codes(list(words[rows]), length - kind) for kind, rows in sides.items() if len(rows)}
    if len(points) and asked:
        letters = np.unique(np.concatenate([np.unique(codes), *[np.unique(c) for c in asked.values()]]))
        counts = _counted(codes, letters)
        most = counts.max(axis=0)
        for c in asked.values():
            for at in range(0, len(c), TOGETHER):
                most = np.maximum(most, _counted(c[at : at + TOGETHER], letters).max(axis=0))
        tree = _Tree(counts, _unary(counts, most))
        for kind, c in asked.items():
            fits = _one_inserted if kind else _one_replaced
            for at in range(0, len(c), TOGETHER):
                part, mine = c[at : at + TOGETHER], sides[kind][at : at + TOGETHER]
                unary = _unary(_counted(part, letters), most)
                for question, word in tree.in_range(unary, 1, 1 - kind):
                    ok = fits(part[question], codes[word])
                    u, v = mine[question[ok]], points[word[ok]]
                    np.add.at(near, u, 1)
                    np.minimum.at(best, u, rank[v])
                    if kind:  # the longer word never asks
                        np.add.at(near, v, 1)
                        np.minimum.at(best, v, rank[u])
    rows = np.flatnonzero(near)
    first = order[best[rows]]
    return pa.table(
        {
            "word": pa.array(words[rows], pa.string()),
            "n_near": pa.array(near[rows]),
            "best_n": pa.array(ns[first]),
            "best": pa.array(words[first], pa.string()),
        }
    )


def damaged(run: Column, doc_id: Column, every: int = 31) -> Column:
    """``run`` with one code point left out, where a checksum of doc_id and run says so.

    Known misspellings for measuring: ``every`` divides the checksum h, and code point
    h % length goes. A NULL doc_id leaves the run as it is.
    """
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)
