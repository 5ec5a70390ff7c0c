"""Reply parsing and the escalation ladder, against cases and a plain model of it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from upswell.functions import replies
from upswell.operators import canon, routing

OK = '[{"id": 1, "canonical": "Rock", "confidence": 0.9}]'


def parsed(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "batch_no bigint, raw string")
    rows = routing.parse_replies(frame).orderBy("batch_no").collect()
    return [None if r["items"] is None else [tuple(i) for i in r["items"]] for r in rows]


def test_reply_shapes(spark):
    item = [(1, 1, "Rock", 0.9, False)]
    good = [OK, '{"items": %s}' % OK, f"```json\n{OK}\n```", f"  ```\n{OK}```  ", f"\n{OK}\n"]
    assert parsed(spark, *good) == [item] * 5
    bad = ["", "not json", "[1, 2]", '{"items": 3}', '"x"', "null", f"{OK} x", f"{OK}]", f"{OK}}}", "[{]", "```", '{"other": []}', "[null]"]
    assert parsed(spark, *bad, None) == [None] * (len(bad) + 1)
    assert parsed(spark, "[]", '{"items": []}') == [[], []]


def test_ids(spark):
    ids = ["1", "1.0", "1e0", "true", '"1"', "1.5", "null", "[1]", "9007199254740993"]
    text = "[" + ",".join('{"id": %s}' % i for i in ids) + ', {"x": 1}]'
    assert [i[1] for i in parsed(spark, text)[0]] == [1, 1, 1, 1, None, None, None, None, 9007199254740993, None]


def test_terms_flags_and_confidence(spark):
    terms = ['"Rock"', '""', '"  "', '"　"', "5", "null", '" Rock"']
    text = "[" + ",".join('{"canonical": %s}' % t for t in terms) + "]"
    assert [i[2] for i in parsed(spark, text)[0]] == ["Rock", None, None, None, None, None, " Rock"]
    flags = ["true", "1", '"x"', '"false"', "[0]", '{"a":1}', "0.5", "false", "0", "0.0", '""', "[]", "{}", "null"]
    text = "[" + ",".join('{"is_new": %s}' % f for f in flags) + ", {}]"
    assert [i[4] for i in parsed(spark, text)[0]] == [True] * 7 + [False] * 8
    sure = ["0.8", "1", "true", "false", '"0.9"', "null", "[1]"]
    text = "[" + ",".join('{"confidence": %s}' % s for s in sure) + "]"
    assert [i[3] for i in parsed(spark, text)[0]] == [0.8, 1.0, 1.0, 0.0, None, None, None]


def test_confidence_gate(one):
    gate = lambda c: replies.conf_ok(F.lit(c).cast("double"), 0.8)
    assert one(gate(0.8), gate(0.79), gate(float("nan")), gate(None)) == (True, False, True, False)


# ---- the ladder ------------------------------------------------------------------
def route(spark, work, lite, flash, vocab=("Miku", "Rock"), **kw):
    frames = (
        spark.createDataFrame(work, "batch_no bigint, pos int, id bigint, name string"),
        spark.createDataFrame(lite, "batch_no bigint, attempt int, raw string"),
        spark.createDataFrame(flash, "batch_no bigint, raw string"),
        spark.createDataFrame([(t,) for t in vocab], "term string"),
    )
    rows = routing.route(*frames, **kw).orderBy("batch_no", "pos").collect()
    return {r.id: r for r in rows}


def reply(*items):
    return json.dumps({"items": [dict(zip(("id", "canonical", "confidence", "is_new"), i)) for i in items]})


CASES = {
    "passes": ([(1, "Miku", 0.98)], None, {}, "canon_lite"),
    "new term": ([(1, "Fresh", 0.9, True)], [(1, "Fresh", 0.95, True)], {}, "canon_flash"),
    "low confidence": ([(1, "Rock", 0.55)], [(1, "Rock", 0.9)], {}, "canon_flash"),
    "empty term": ([(1, "")], [(1, "Rock", 0.88)], {}, "canon_flash"),
    "second tier unsure": ([(1, "Rock", 0.55)], [(1, "Rock", 0.5)], {}, "demoted"),
    "second tier silent": ([(1, "Rock", 0.55)], None, {}, "demoted"),
    "no budget": ([(1, "Rock", 0.55)], [(1, "Rock", 0.9)], {"cap": 0}, "pending"),
}


@pytest.mark.parametrize("case", CASES)
def test_ladder(spark, case):
    lite, flash, kw, status = CASES[case]
    out = route(
        spark, [(0, 1, 1, "tag")], [(0, 1, reply(*lite))], [(0, reply(*flash))] if flash else [], **kw
    )
    assert out[1].status == status
    assert out[1].registers_vocab == (case == "new term")


def test_retry_and_double_failure(spark):
    work = [(0, 1, 1, "a"), (1, 1, 2, "b"), (2, 1, 3, "c")]
    lite = [
        (0, 1, "broken"), (0, 2, reply((1, "Miku", 0.98))),
        (1, 1, reply((9, "Miku", 0.9))), (1, 2, None),
        (2, 1, reply((3, "Rock", 0.9))), (2, 2, reply((3, "Rock", 0.1))),
    ]
    out = route(spark, work, lite, [(1, reply((2, "Miku", 0.97)))])
    assert [out[i].status for i in (1, 2, 3)] == ["canon_lite", "canon_flash", "canon_lite"]
    assert out[2].lite_canon is None


def model(work, lite, flash, vocab, cap, threshold=0.8):
    """What the ladder means, one batch after the other."""
    def usable(text, ids):
        try:
            items = json.loads(text)["items"]
            return items if {i["id"] for i in items} == set(ids) else None
        except (TypeError, ValueError, KeyError):
            return None

    def sure(item):
        c = item.get("confidence")
        return isinstance(c, (int, float)) and not c < threshold

    def term(item):
        c = item.get("canonical")
        return c if isinstance(c, str) and c.strip() else None

    out = {}
    for no in sorted({w[0] for w in work}):
        ids = [w[2] for w in sorted(work) if w[0] == no]
        items = usable(lite.get((no, 1)), ids) or usable(lite.get((no, 2)), ids)
        line, proposal = [], {}
        for item in items or []:
            if term(item) in vocab and not item.get("is_new") and sure(item):
                out[item["id"]] = ("canon_lite", item["canonical"], None)
            else:
                line.append(item["id"])
                if term(item):
                    proposal[item["id"]] = term(item)
        if items is None:
            line = ids
        sent, late = line[:cap], line[cap:]
        for i in late:
            out[i] = ("pending", None, None)
        answers = {i["id"]: i for i in usable(flash(no, set(sent)), sent) or []}
        for i in set(sent):
            a = answers.get(i)
            fine = a is not None and term(a) and sure(a)
            out[i] = ("canon_flash", a["canonical"], proposal.get(i)) if fine else ("demoted", None, proposal.get(i))
        cap -= len(set(sent))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ladder_against_model(spark, seed):
    rng = random.Random(seed)
    size, n = 4, 9
    work = [(b, p + 1, 100 * b + p, f"t{b}{p}") for b in range(n) for p in range(size)]
    terms, vocab = ["Miku", "Rock", "Odd", "", "  ", None], {"Miku", "Rock"}

    def item(i):
        return {"id": i, "canonical": rng.choice(terms), "confidence": rng.choice([0.1, 0.8, 0.95, "0.9", None]),
                "is_new": rng.choice([False, False, True, 0, 1, ""])}

    def answer(ids, broken):
        items = [item(i) for i in ids]
        rng.shuffle(items)
        items += [item(rng.choice(ids)) for _ in range(rng.choice([0, 0, 2]))] if ids else []
        if rng.random() < broken:
            return rng.choice([None, "{", json.dumps({"items": items[1:]})])
        return json.dumps({"items": items})

    ids = {b: [w[2] for w in work if w[0] == b] for b in range(n)}
    lite = {(b, a): answer(ids[b], 0.4) for b in range(n) for a in (1, 2)}
    cap = rng.choice([0, 3, 7, 15, 100])
    answers = {}

    def flash(no, sent):
        if no not in answers:
            answers[no] = answer(sorted(sent), 0.25)
        return answers[no]

    expected = model(work, lite, flash, vocab, cap)
    out = route(
        spark, work, [(b, a, t) for (b, a), t in lite.items()], list(answers.items()), tuple(vocab), cap=cap
    )
    assert {i: (r.status, r.canon_name, r.lite_canon) for i, r in out.items() if r.status != "canon_lite"} == {
        i: e for i, e in expected.items() if e[0] != "canon_lite"
    }
    assert {i: r.canon_name for i, r in out.items() if r.status == "canon_lite"} == {
        i: e[1] for i, e in expected.items() if e[0] == "canon_lite"
    }


def test_outage_defers_that_batch_and_later_ones(spark):
    work = [(b, 1, b, "t") for b in range(4)]
    lite = [(b, 1, reply((b, "Miku", 0.9))) for b in range(4)]
    out = route(spark, work, lite, [], outages=spark.createDataFrame([(3,), (2,)], "batch_no bigint"))
    assert [out[b].status for b in range(4)] == ["canon_lite", "canon_lite", "pending", "pending"]
    none = spark.createDataFrame([], "batch_no bigint")
    assert route(spark, work, lite, [], outages=none)[3].status == "canon_lite"


def test_queue_and_vocabulary(spark):
    tags = spark.createDataFrame(
        [(1, "a", None, "pending"), (2, "b", None, "demoted"), (3, "c", None, "pending"), (4, "d", "X", "canon_lite"), (5, "e", None, "pending")],
        "id bigint, name string, canon_name string, canon_status string",
    )
    links = spark.createDataFrame(
        [(s, t) for t, n in ((3, 3), (1, 2), (2, 1), (4, 9)) for s in range(n)], "song_id bigint, tag_id bigint"
    )
    rows = canon.work_queue(tags, links).orderBy("batch_no", "pos").collect()
    assert [(r.id, r.uses) for r in rows] == [(3, 3), (1, 2), (2, 1), (5, 0)]
    assert [r.id for r in canon.work_queue(tags, links, 2).orderBy("pos").collect()] == [3, 1]
    full = canon.full_queue(tags, links, 3).orderBy("batch_no", "pos").collect()
    assert [(r.batch_no, r.pos, r.id) for r in full] == [(0, 1, 3), (0, 2, 1), (0, 3, 2), (1, 1, 5)]
    terms = {r.term for r in canon.vocabulary(tags).collect()}
    assert "X" in terms and len(terms) == 98
    payload = canon.batch_payload(canon.work_queue(tags, links)).first().payload
    assert json.loads(payload)[0] == {"id": 3, "name": "c"}


def test_a_repeated_key_counts_with_its_last_value(spark):
    raw = '{"items":[{"id":1,"id":2,"canonical":"Rock","canonical":"Miku","confidence":0.9,"is_new":false}]}'
    replies = spark.createDataFrame([(0, raw)], "batch_no bigint, raw string")
    item = routing.parse_replies(replies).first()["items"][0]
    assert (item.id, item.canonical, item.confidence) == (2, "Miku", 0.9)
