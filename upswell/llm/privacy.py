"""Information-theoretic sanitisation: personal data, and the terms that give it away."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upswell.llm.common import ascii_lower, set_aside
from upswell.session import materialize

#: Kinds of spans in their order; the last is what the corpus adds.
KINDS = ("email", "ip", "card", "phone", "term")
#: Words of the corpus statistics.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does, and gives none of a run back: linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Disclosing terms that one pass over the texts looks for.
TERMS_AT_ONCE = 200_000
#: Words that a task counts before it passes them on.
COUNTED = 200_000
#: Letters that a generalised term keeps.
STEM = 4
_SPANS = "array<struct<kind:int,start:int,end:int,instead:string>>"
_SPAN = pa.struct([*((n, pa.int32()) for n in ("kind", "start", "end")), ("instead", pa.string())])


# ---- rules ---------------------------------------------------------------------
def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every @ to both sides: a long run of letters is looked at once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(last, at + 1))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the checksum of a card number holds."""
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, in the order of ``KINDS`` and starts.

    Matches of a kind are leftmost and do not overlap; a match that fails its check is
    dropped and nothing shorter is tried in its place.
    """
    out = [(0, *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        # Long parts are not numbers worth making.
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def entity(kind: int, value: str) -> str:
    """What two mentions of one entity share: letters folded, digits without their marks."""
    return f"{KINDS[kind]}:{value.translate(_LOWER) if kind < 2 else _digits(value)}"


def _span(kind: int, start: int, end: int, instead: str | None = None) -> dict:
    return {"kind": kind, "start": start, "end": end, "instead": f"[{KINDS[kind]}]" if instead is None else instead}


def text_key(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


# ---- corpus statistics ---------------------------------------------------------
_NAMES = ["doc_id", "text_key", "spans"]


def _found(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key string, spans {_SPANS}"


def marked(docs: DataFrame, reach: int = 10) -> DataFrame:
    """(doc_id, text_key, spans, near) of every row: what the rules find, and the words around it.

    ``near`` has (entity, term, left, right) once per entity and word: words near an
    entity's mentions in this row. The words of the mention itself count as near: they may
    stand alone elsewhere. left and right tell the surroundings apart by the three words
    furthest out on each side. There are at most ``2 * reach`` words per mention besides the
    mention's own.
    """
    near_fields = ("entity", "term", "left", "right")
    near_type = pa.list_(pa.struct([(n, pa.string()) for n in near_fields]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            found = [base_spans(t) for t in texts]
            spans = [[_span(*s) for s in each] for each in found]
            near = [_near(t, each, reach) if each else [] for t, each in zip(texts, found)]
            columns = [
                batch["doc_id"],
                pa.array(map(text_key, texts), pa.string()),
                pa.array(spans, pa.list_(_SPAN)),
                pa.array([[dict(zip(near_fields, row)) for row in rows] for rows in near], near_type),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*_NAMES, "near"])

    shape = _found(docs) + ", near array<struct<entity:string,term:string,left:string,right:string>>"
    return docs.select("doc_id", "text").mapInArrow(mark, shape)


def _near(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[tuple[str, str, str, str]]:
    words = [(m.group(), m.start(), m.end()) for m in _TERM.finditer(text.translate(_LOWER))]
    ends = [end for _, _, end in words]
    seen, rows = set(), []
    for kind, start, end in spans:
        name = entity(kind, text[start:end])
        first = _first_over(ends, start)
        after = first
        while after < len(words) and words[after][1] < end:
            after += 1
        outer = [w for w, _, _ in words[max(0, first - reach) : after + reach]]
        left, right = (text_key(" ".join(side)) for side in (outer[:3], outer[-3:]))
        for word in outer:
            if (name, word) not in seen:
                seen.add((name, word))
                rows.append((name, word, left, right))
    return rows


def _first_over(ends: list[int], start: int) -> int:
    low, high = 0, len(ends)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if ends[middle] <= start else (low, middle)
    return low


def term_rows(docs: DataFrame) -> DataFrame:
    """(term, rows): in how many rows each word of the corpus stands.

    Each task counts up to ``COUNTED`` words before it passes them on, and what moves is
    folded once more: the vocabulary, not the texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                if text:
                    counts.update(set(_TERM.findall(text.translate(_LOWER))))
                if len(counts) >= COUNTED:
                    yield _counts(counts)
                    counts.clear()
        yield _counts(counts)

    found = docs.select("text").mapInArrow(count, "term string, rows bigint")
    return found.groupBy("term").agg(F.sum("rows").alias("rows"))


def _counts(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "rows"]
    )


def disclosing(docs: DataFrame, alpha: float = 1.1, support: int = 3, reach: int = 10, marks: DataFrame | None = None) -> DataFrame:
    """(term, entity, information, replacement): the words that reveal an entity, and what may stand instead.

    An entity is a value that the rules find. Its information is -log2 of the share of rows
    that mention it; a word's pointwise mutual information with it, over rows in which the
    word stands near a mention, is what the word tells of it. A word reveals an entity if it
    tells ``1 / alpha`` of the entity's information or more (alpha 1: only words that never
    stand without it). ``support`` different surroundings on either side must show the two
    together, so copies of one passage are no evidence. A word that reveals several entities
    is listed with the one it tells most of (of equals, the first by name).

    A revealing word is generalised to its first ``STEM`` letters if all words that start
    with them tell less than that share together; else replacement is empty: it is removed.

    ``marks`` is what ``marked(docs, reach)`` gave, if that is at hand. An empty table, and
    one without entities, gives no rows.
    """
    marks = materialize(marked(docs, reach)) if marks is None else marks
    total = marks.count()
    near = marks.select(F.explode("near").alias("n")).select("n.*")
    # Equal surroundings fold in the map tasks before either side is counted.
    pairs = materialize(near.groupBy("entity", "term", "left", "right").agg(F.count(F.lit(1)).alias("n")))
    mentioned = pairs.groupBy("entity", "term").agg(
        F.sum("n").alias("together"), F.count_distinct("left").alias("lefts"), F.count_distinct("right").alias("rights")
    )
    # The words of the mention itself are in every row that has it, so the largest count is the entity's.
    entities = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n")).groupBy("entity").agg(F.max("n").alias("mentions"))
    counts = materialize(term_rows(docs))
    backed = materialize(mentioned.where(F.least("lefts", "rights") >= support).drop("lefts", "rights"))
    told = backed.join(entities, "entity").join(counts, "term")
    judged = materialize(told.where(_reveals(total, "together", "rows", "mentions", alpha)))
    # All words with the same first letters, near the same entity and anywhere.
    stem = F.when(F.length("term") > STEM + 1, F.substring("term", 1, STEM)).alias("stem")
    stems = judged.select("entity", "mentions", stem).where("stem is not null").distinct()
    wide = counts.select(stem, "rows").join(stems.select("stem").distinct(), "stem").groupBy("stem").agg(F.sum("rows").alias("rows"))
    close = pairs.select("entity", stem, "n").groupBy("entity", "stem").agg(F.sum("n").alias("together"))
    safe = stems.join(close, ["entity", "stem"]).join(wide, "stem").where(~_reveals(total, "together", "rows", "mentions", alpha))
    replaced = judged.withColumn("stem", stem).join(
        safe.select("entity", "stem", F.lit(True).alias("_safe")), ["entity", "stem"], "left"
    )
    replacement = F.when(F.col("_safe"), F.concat("stem", F.lit("*"))).otherwise(F.lit(""))
    information = _information(total, "together", "rows", "mentions")
    order = F.struct((-information).alias("less"), "entity")
    # A word is generalised only if that is safe for every entity it reveals.
    listed = replaced.groupBy("term").agg(F.min(order).alias("first"), F.min(replacement).alias("replacement"))
    return listed.select("term", "first.entity", (-F.col("first.less")).alias("information"), "replacement")


def _information(total: int, together: str, rows: str, mentions: str) -> Column:
    """Pointwise mutual information in bits."""
    return F.log2(F.col(together) * F.lit(float(max(total, 1))) / (F.col(rows) * F.col(mentions).cast("double")))


def _reveals(total: int, together: str, rows: str, mentions: str, alpha: float) -> Column:
    own = F.log2(F.lit(float(max(total, 1))) / F.col(mentions))
    return (own > 0) & (_information(total, together, rows, mentions) >= own / alpha - 1e-9)


# ---- spans and clean texts -----------------------------------------------------
def _terms_in(docs: DataFrame, terms: dict[str, str]) -> DataFrame:
    """(doc_id, text_key, spans) of the rows in which one of ``terms`` stands outside the base spans."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, keys, spans = [], [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                low = (text or "").translate(_LOWER)
                if terms.keys().isdisjoint(_TERM.findall(low)):
                    continue
                taken = bytearray(len(low))
                for _, start, end in base_spans(text):
                    taken[start:end] = b"\1" * (end - start)
                words = [(m.group(), *m.span()) for m in _TERM.finditer(low)]
                found = [_span(4, a, b, terms[w]) for w, a, b in words if w in terms and not any(taken[a:b])]
                if found:
                    took.append(row)
                    keys.append(text_key(text))
                    spans.append(found)
            ids = batch["doc_id"].take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), pa.array(spans, pa.list_(_SPAN))], _NAMES)

    return docs.select("doc_id", "text").mapInArrow(look, _found(docs))


def find(docs: DataFrame, terms: DataFrame | None = None, **how) -> DataFrame:
    """(doc_id, text_key, spans): all spans of every row by kind and start, in code points.

    Kinds are numbered as in ``KINDS``. ``terms`` is what ``disclosing(docs, **how)`` gives,
    by default over ``docs`` themselves. Every row of ``docs`` gives one row, repeated ones
    too; a NULL text is empty; doc_id may be NULL. Texts of any length are scanned whole, in
    time linear in their length. An empty table gives no rows.

    Texts do not move. Revealing words come to the driver ``TERMS_AT_ONCE`` at a time, and
    each such set is looked for in one pass.
    """
    marks = materialize(marked(docs, how.get("reach", 10)))
    terms = materialize((disclosing(docs, marks=marks, **how) if terms is None else terms).select("term", "replacement"))
    base = marks.drop("near")
    passes = -(-terms.count() // TERMS_AT_ONCE)
    if not passes:
        return base
    found = None
    for nth in range(passes):
        due = terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == nth)
        part = materialize(_terms_in(docs, {r.term: r.replacement for r in due.toLocalIterator()}))
        found = part if found is None else found.unionByName(part)
    # Rows that repeat doc_id and text have the same spans.
    once = found.select("doc_id", "text_key", F.explode("spans").alias("s")).distinct()
    extra = once.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("s").alias("_more"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    spans = F.array_sort(F.concat("spans", F.coalesce("_more", F.array().cast(_SPANS))))
    return base.join(materialize(extra), same, "left").select("doc_id", "text_key", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """``docs``, all columns, with personal data replaced by ``[kind]`` and revealing words generalised or removed.

    Of overlapping spans the one that starts first counts, of those the first kind. NULL
    texts stay NULL.
    """
    found = find(docs, **how).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"))
    aside, back = set_aside(docs, ["_id", "_key", "_spans"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("_key"))
    done = aside.join(found, same, "left").withColumn(
        "text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(_rewritten("text", "_spans"))
    )
    return done.select(*back(done))


@F.arrow_udf(T.StringType())
def _rewritten(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        parts, at = [], 0
        for s in sorted(found or [], key=lambda s: (s["start"], s["kind"])):
            if s["start"] >= at:
                parts += [text[at : s["start"]], s["instead"]]
                at = s["end"]
        out.append(text if text is None else "".join([*parts, text[at:]]))
    return pa.array(out, pa.string())
