"""Personal data by rule against the patterns as written, and words that give it away."""

import hashlib
import math
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from upswell.llm import privacy, queries

SF = "/root/testdata/sf0.01"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def checksum(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                13 <= len(digits) <= 19 and checksum(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text("a1@.+- ()é%23", max_size=40))
def test_rules_on_any_text(text):
    assert privacy.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", [
    "4111 1111 1111 1111", "4111-1111-1111-1112", "x4111111111111111y 378282246310005", "+1 (386) 555-3733 4041894974608795",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "a@b@c.d e.f@g-h.i.j. @x.y p%q+r@s.t@u.v", "+49 30 1234567. +123", "١.2.3.4 ٣@x.y",
])
def test_rules(text):
    assert privacy.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "1." * 1_000_000, "+1" * 500_000, "@" * 500_000, "a@" * 500_000, "+1" + "-" * 1_000_000])
def test_long_texts_take_linear_time(text):
    start = time.time()
    privacy.base_spans(text)
    assert time.time() - start < 20


def listed(spans):
    return ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def test_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_private_spans"](spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 50
    for r in rows:
        base = plain(texts[r.doc_id])
        counts = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in range(4))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert r.spans.startswith(listed(base))


FILL = "river stone window garden letter morning paper bridge silver orange market castle".split()


def notes(n):
    """A person's name stands near an address in ever other words, and sometimes alone."""
    words = lambda k: " ".join(FILL[(k * 7 + j * j) % 12] + str((k * j) % 5) for j in range(12))
    docs = [f"{words(k)} contact Kowalska at ANNA.K@x.example.com please {words(k + 3)}" for k in range(6)]
    docs += [f"{words(k)} Kowalska said so {words(k + 1)}", f"{words(k)} contact us please {words(k)}"] if (k := 40) else []
    docs += [f"{words(k)} contact other{k} at o{k}@y.example.com please {words(k + 2)}" for k in range(100, 110)]
    docs += [f"{words(k)} contact nobody at all please {words(k + 5)}" for k in range(200, 200 + n)]
    # Copies of one passage: its words are near one address, but in one surrounding.
    docs += [f"{words(300)} zanzibar wrote from c@z.example.com again {words(301)}"] * 9
    return docs


def by_hand(texts, reach=10, alpha=1.1, support=3):
    """term to (entity, information) by plain counting."""
    total, rows, together, sides, mentions = len(texts), Counter(), Counter(), {}, Counter()
    for text in texts:
        low = text.translate({c: c + 32 for c in range(65, 91)})
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(privacy.TERM, low)]
        rows.update({w for w, _, _ in words})
        seen, names = set(), set()
        for kind, a, b in plain(text):
            name = f"{privacy.KINDS[kind]}:" + (low[a:b] if kind < 2 else re.sub("[^0-9]", "", text[a:b]))
            names.add(name)
            inside = [i for i, (_, s, e) in enumerate(words) if s < b and e > a]
            outer = [w for w, _, _ in words[max(0, inside[0] - reach) : inside[-1] + 1 + reach]]
            for w in outer:
                if (name, w) not in seen:
                    seen.add((name, w))
                    together[name, w] += 1
                    left, right = sides.setdefault((name, w), (set(), set()))
                    left.add(tuple(outer[:3]))
                    right.add(tuple(outer[-3:]))
        mentions.update(names)
    out = {}
    for (name, w), n in together.items():
        own = math.log2(total / mentions[name])
        told = math.log2(n * total / (rows[w] * mentions[name]))
        if min(map(len, sides[name, w])) >= support and own > 0 and told >= own / alpha - 1e-9:
            out[w] = min(out.get(w, (0, "~")), (-told, name))
    return {w: (name, round(-told, 9)) for w, (told, name) in out.items()}


@pytest.mark.parametrize("n", [60, 600])
def test_disclosing_words(spark, n):
    texts = notes(n)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.term: (r.entity, round(r.information, 9)) for r in privacy.disclosing(frame).collect()}
    assert found == by_hand(texts)
    assert "kowalska" in found and not found.keys() & {"contact", "please", "zanzibar", "example", "com"}


def test_spans_and_clean_texts(spark):
    texts = notes(60)
    frame = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    spans = {r.doc_id: r.s for r in privacy.find(frame).select("doc_id", privacy.listed(F.col("spans")).alias("s")).collect()}
    at = texts[6].index("Kowalska")
    assert spans[6] == f"term:{at}:{at + 8}" and spans[7] == ""
    clean = {r.doc_id: r for r in privacy.sanitise(frame).collect()}
    assert clean[7].text == texts[7] and clean[7].spans == "mine"
    assert "owalska" not in clean[6].text and "[email]" in clean[0].text and "ANNA" not in clean[0].text
    # In many passes the same.
    before = privacy.TERMS_AT_ONCE
    try:
        privacy.TERMS_AT_ONCE = 1
        again = {r.doc_id: r.s for r in privacy.find(frame).select("doc_id", privacy.listed(F.col("spans")).alias("s")).collect()}
    finally:
        privacy.TERMS_AT_ONCE = before
    assert again == spans


def test_generalised_only_where_safe(spark):
    """Words that share their first letters with common ones keep these; rare beginnings go."""
    texts = [t.replace("Kowalska", "contrarian") for t in notes(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.term: r.replacement for r in privacy.disclosing(frame).collect()}["contrarian"] == "cont*"
    other = spark.createDataFrame(list(enumerate(notes(60))), "doc_id bigint, text string")
    assert {r.term: r.replacement for r in privacy.disclosing(other).collect()}["kowalska"] == ""


def test_nulls_repeats_and_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert privacy.find(none).collect() == [] and privacy.sanitise(none).collect() == []
    rows = [(1, None), (None, "a@b.cd"), (None, "a@b.cd"), (2, ""), (2, "call +1 386 555 3733 now")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in privacy.find(docs).collect()), key=repr)
    assert found == sorted([(1, []), (None, [(0, 0, 6)]), (None, [(0, 0, 6)]), (2, []), (2, [(3, 5, 20)])], key=repr)
    clean = sorted((tuple(r) for r in privacy.sanitise(docs).collect()), key=repr)
    assert clean == sorted([(1, None), (None, "[email]"), (None, "[email]"), (2, ""), (2, "call [phone] now")], key=repr)
