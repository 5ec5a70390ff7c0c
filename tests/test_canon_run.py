import json
import sys
import zlib

import pytest
from pyspark import cloudpickle

from upswell.plans import canon_run
from upswell.plans.canon_run import Growth, ServiceUnavailable, normalize, normalize_growing

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCAB = ["Miku", "Rock"]


def run(spark, names, call, size=1, how=normalize, **kw):
    work = spark.createDataFrame(
        [(i // size, i % size + 1, i + 1, n) for i, n in enumerate(names)],
        "batch_no bigint, pos int, id bigint, name string",
    )
    vocab = spark.createDataFrame([(t,) for t in VOCAB], "term string")
    results, grown = how(work, vocab, call, **kw)
    rows = results.orderBy("batch_no", "pos").collect()
    return [r.status for r in rows], {r.term for r in grown.collect()}


def answer(payload, **fields):
    return json.dumps({"items": [{"id": i["id"], **fields} for i in json.loads(payload)]})


def grows(model, payload, vocab):
    known = "Fresh" in json.loads(vocab)
    return answer(payload, canonical="Fresh", confidence=0.95, is_new=not known)


def test_vocabulary_grows_between_rounds(spark):
    statuses, vocab = run(spark, ["x", "y"], grows)
    assert statuses == ["canon_flash", "canon_lite"] and vocab == {"Miku", "Rock", "Fresh"}


def test_one_round_sees_one_vocabulary(spark):
    statuses, vocab = run(spark, ["x", "y"], grows, batches_per_round=2)
    assert statuses == ["canon_flash", "canon_flash"] and "Fresh" in vocab


def unsure(model, payload, vocab):
    return answer(payload, canonical="Rock", confidence=0.9 if model == "gw-flash" else 0.2)


def test_budget_is_for_the_run(spark):
    assert run(spark, ["a", "b", "c"], unsure, cap=1)[0] == ["canon_flash", "pending", "pending"]
    assert run(spark, ["a", "b", "c"], unsure, cap=2, batches_per_round=3)[0] == ["canon_flash", "canon_flash", "pending"]


def down(model, payload, vocab):
    raise ServiceUnavailable


def down_later(model, payload, vocab):
    if json.loads(payload)[0]["id"] == 3:
        raise ServiceUnavailable
    return answer(payload, canonical="Rock", confidence=0.9)


def test_outages(spark):
    assert run(spark, ["a", "b"], down)[0] == ["pending", "pending"]
    assert run(spark, ["a", "b", "c", "d"], down_later)[0] == ["canon_lite", "canon_lite", "pending", "pending"]
    assert run(spark, ["a", "b", "c", "d"], down_later, batches_per_round=3)[0] == [
        "canon_lite", "canon_lite", "pending", "pending"
    ]


def test_no_work(spark):
    assert run(spark, [], down) == ([], {"Miku", "Rock"})


def drawn(*what):
    return zlib.crc32(repr(what).encode()) % 100


def varied(model, payload, vocab):
    """Terms shared by many batches, some declined, some replies cut off, second opinions that differ."""
    known, items, given = set(json.loads(vocab)), [], json.loads(payload)
    for item in given:
        term = f"term {drawn(item['id'], 'term') % 13}" if drawn(item["id"]) > 10 else "Rock"
        sure = 0.9 if drawn(model, item["id"], "sure") > 30 else 0.3
        if model == "gw-flash" and drawn(item["id"], "other") < 20:
            term = f"term {drawn(item['id'], 'else') % 13}"
        items.append({"id": item["id"], "canonical": term, "confidence": sure, "is_new": term not in known})
    text = json.dumps({"items": items})
    return text[:20] if drawn(model, given[0]["id"], len(given), "cut") < 15 else text


def breaks_late(model, payload, vocab):
    if any(i["id"] == 47 for i in json.loads(payload)):
        raise ServiceUnavailable
    return varied(model, payload, vocab)


def breaks_second(model, payload, vocab):
    if model == "gw-flash" and any(42 <= i["id"] for i in json.loads(payload)):
        raise ServiceUnavailable
    return varied(model, payload, vocab)


@pytest.mark.parametrize(("call", "cap"), [(varied, 12), (breaks_late, 1000), (breaks_second, 1000)])
def test_growing_gives_the_strict_order(spark, call, cap):
    names = [f"n{i}" for i in range(60)]
    strict = run(spark, names, call, size=10, cap=cap)
    assert run(spark, names, call, size=10, cap=cap, how=normalize_growing) == strict
    assert len(strict[1]) > 5 and len(set(strict[0])) >= 3


def test_growing_takes_few_rounds(spark, monkeypatch):
    """Twenty batches of which most propose terms of earlier ones: no more rounds than terms depend on each other."""
    sent = []
    ask = canon_run.score_batches

    def counted(batches, call, model, *rest):
        sent.append((model, batches.count()))
        return ask(batches, call, model, *rest)

    monkeypatch.setattr(canon_run, "score_batches", counted)
    statuses, vocab = run(spark, [f"n{i}" for i in range(60)], grows, size=3, how=normalize_growing)
    assert statuses == ["canon_flash"] * 3 + ["canon_lite"] * 57 and "Fresh" in vocab
    lite = [n for model, n in sent if model == "gw-gemma" and n]
    assert lite == [20, 19] and len(sent) <= 3 * 3


def test_growing_without_work_and_with_outages(spark):
    assert run(spark, [], down, how=normalize_growing) == ([], {"Miku", "Rock"})
    assert run(spark, ["a", "b"], down, how=normalize_growing)[0] == ["pending", "pending"]
    assert run(spark, ["a", "b", "c", "d"], down_later, how=normalize_growing)[0] == ["canon_lite", "canon_lite", "pending", "pending"]


def test_vocabulary_of_a_batch():
    growth = Growth(("b", "é"), ((3, "a"), (5, "z")))
    assert [growth(n) for n in (3, 4, 6)] == ['["b","é"]', '["a","b","é"]', '["a","b","z","é"]']
