"""Canonicalization with a live model function.

A later batch may use terms an earlier one confirmed. ``normalize`` sends batches in rounds:
the vocabulary is fixed within a round and grows between rounds. Rounds of one batch follow
the strict order; larger rounds send their batches in parallel. ``normalize_growing`` gives
the results of the strict order with all batches in parallel, and asks again where a term
was confirmed that a reply had proposed without knowing so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.fixed_values import (
    CANON_FLASH,
    CONFIDENCE_THRESHOLD,
    DEMOTED,
    ESCALATION_CAP,
    FLASH_MODEL,
    LITE_MODEL,
)
from upswell.operators import canon, routing
from upswell.plans.calls import ServiceUnavailable, tasks_for
from upswell.session import materialize, steps_dir

#: Called in a task with (model, payload JSON, vocabulary JSON); returns the reply text.
ModelCall = Callable[[str, str, str], "str | None"]


@dataclass(frozen=True)
class Growth:
    """The vocabulary of every batch: what is known from the start, and each term's batch since then.

    It travels with the tasks. A prompt carries all of it, so it is no larger than one.
    """

    start: tuple[str, ...]
    since: tuple[tuple[int, str], ...] = ()

    def __call__(self, batch_no: int) -> str:
        terms = {*self.start, *(term for at, term in self.since if at < batch_no)}
        return json.dumps(sorted(terms), ensure_ascii=False, separators=(",", ":"))


def score_batches(
    batches: DataFrame,
    call: ModelCall,
    model: str,
    vocab: Column | str | Growth,
    attempt: int,
    calls_at_once: int | None = None,
) -> DataFrame:
    """Sends every batch row's payload; the replies are stored before use.

    Result: ``batch_no, attempt, raw, outage``. A lost executor repeats the calls of
    its unfinished tasks, no others. There are as many tasks as batches, up to
    ``calls_at_once`` (by default the cluster's cores). The vocabulary, which fits a
    prompt, is one value that travels with the tasks; with ``Growth`` each batch has its own.
    """
    spark = batches.sparkSession
    if isinstance(vocab, Growth):
        terms_for = vocab
    else:
        terms = vocab if isinstance(vocab, str) else spark.range(1).select(vocab).first()[0]
        terms_for = lambda _: terms
    sendable = batches.select("batch_no", "payload")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raws, outages = [], []
            for batch_no, payload in zip(frame["batch_no"], frame["payload"]):
                try:
                    raws.append(call(model, payload, terms_for(batch_no)))
                    outages.append(False)
                except ServiceUnavailable:
                    raws.append(None)
                    outages.append(True)
            yield pd.DataFrame(
                {
                    "batch_no": frame["batch_no"],
                    "attempt": attempt,
                    "raw": pd.Series(raws, dtype="object", index=frame.index),
                    "outage": outages,
                }
            )

    sent = sendable.repartition(tasks_for(batches, sendable.count(), calls_at_once), "batch_no")
    return materialize(
        sent.mapInPandas(ask, "batch_no bigint, attempt int, raw string, outage boolean")
    )


def _lite_replies(
    wanted: DataFrame, batched: DataFrame, call: ModelCall, vocab: str | Growth
) -> DataFrame:
    """First-tier replies: a second attempt where the first does not echo the ids."""
    first = score_batches(batched, call, LITE_MODEL, vocab, 1)
    passed = routing.gate_ids(wanted, routing.parse_replies(first)).where(F.col("ids_ok") | F.col("outage"))
    again = batched.join(passed.select("batch_no"), "batch_no", "left_anti")
    return first.unionByName(score_batches(again, call, LITE_MODEL, vocab, 2))


def _sent(work: DataFrame, capped: DataFrame) -> DataFrame:
    """What the second tier is asked: the escalated items of each batch in escalation order."""
    escalated = work.join(capped.where("escalated").select("batch_no", "id", "place"), ["batch_no", "id"])
    return canon.batch_payload(escalated.select("batch_no", F.col("place").alias("pos"), "id", "name"))


def _round(
    work: DataFrame, vocab: DataFrame, call: ModelCall, threshold: float, cap: int
) -> tuple[DataFrame, bool]:
    terms = vocab.sparkSession.range(1).select(canon.vocabulary_json(vocab)).first()[0]
    wanted = routing.requested_ids(work)
    batched = canon.batch_payload(work)
    lite = _lite_replies(wanted, batched, call, terms)
    lite_out = lite.where("outage").select("batch_no")
    live = routing.before_outage(work, lite_out)
    capped = routing.escalate(live, lite.drop("outage"), vocab, threshold, cap)
    flash = score_batches(_sent(live, capped), call, FLASH_MODEL, terms, 1)
    outages = lite_out.unionByName(flash.where("outage").select("batch_no"))
    settled = routing.settle(live, capped, flash.drop("attempt", "outage"), threshold)
    done = routing.before_outage(settled, outages)
    results = materialize(done.unionByName(routing.deferred(work, outages)))
    return results, not outages.isEmpty()


def normalize(
    work: DataFrame,
    vocab: DataFrame,
    call: ModelCall,
    threshold: float = CONFIDENCE_THRESHOLD,
    cap: int = ESCALATION_CAP,
    batches_per_round: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Routes all of ``work``; returns its results and the grown vocabulary.

    Only counters come to the driver: the last batch number, the escalations used
    and whether there was an outage.
    """
    work = materialize(work.select("batch_no", "pos", "id", "name"))
    last = work.agg(F.max("batch_no")).first()[0]
    spark = work.sparkSession
    folder = f"{steps_dir(spark)}/upswell-rounds-{uuid.uuid4().hex}"
    # No batch yet: an empty result with the right columns.
    empty = routing.deferred(work.limit(0), work.select("batch_no"))
    empty.write.parquet(folder)
    for start in range(0, 0 if last is None else last + 1, batches_per_round):
        end = start + batches_per_round
        due = work.where((F.col("batch_no") >= start) & (F.col("batch_no") < end))
        part, stopped = _round(due, vocab, call, threshold, cap)
        part.write.mode("append").parquet(folder)
        vocab = materialize(vocab.union(routing.new_terms(part)).distinct())
        if stopped:
            later = work.where(F.col("batch_no") >= end)
            routing.deferred(later, later.select("batch_no")).write.mode("append").parquet(folder)
            break
        # A round uses no more than the budget it was given, so this stays at or above 0.
        cap -= part.where(F.col("status").isin(CANON_FLASH, DEMOTED)).count()
    # One scan of all rounds, however many there were.
    return spark.read.schema(empty.schema).parquet(folder), vocab


def normalize_growing(
    work: DataFrame,
    vocab: DataFrame,
    call: ModelCall,
    threshold: float = CONFIDENCE_THRESHOLD,
    cap: int = ESCALATION_CAP,
) -> tuple[DataFrame, DataFrame]:
    """As ``normalize`` batch by batch, with the jobs of a few rounds whatever the number of batches.

    Every batch has a vocabulary of its own: the terms known from the start and those that an
    earlier batch confirmed. All batches are sent at once. What they confirm gives each term
    its first batch, and with it the batches whose replies proposed a term that has become
    known to them, or is known no longer; only these are sent again, with the vocabulary they
    should have had. Escalations and the budget are settled for all batches together in every
    round, from stored replies; the second tier is asked again where the escalated items
    changed. The rounds end when no batch is left to ask.

    A batch depends on earlier ones only, so each round settles the first unsettled batch at
    least, in practice all whose terms are settled: there are as many rounds as confirmed
    terms depend on each other. The results are those of the strict order if a reply depends
    on the vocabulary by the terms it proposes; for any other model function there is
    ``normalize`` with rounds of one batch.

    An outage in a batch defers it and all later ones. To the driver come the confirmed terms
    (a prompt carries them), the number of the first batch out, and counts.
    """
    work = materialize(work.select("batch_no", "pos", "id", "name"))
    batched = materialize(canon.batch_payload(work).drop("items"))
    wanted = materialize(routing.requested_ids(work))
    start = materialize(vocab.select("term").distinct())
    seed = tuple(sorted(r.term for r in start.collect()))
    terms = start.withColumn("since", F.lit(-1).cast("bigint"))
    growth, due = Growth(seed), batched.select("batch_no")
    no_outage = 1 + (work.agg(F.max("batch_no")).first()[0] or 0)
    limit, known = no_outage, None
    while True:
        lite = _lite_replies(wanted.join(due, "batch_no", "left_semi"), batched.join(due, "batch_no", "left_semi"), call, growth)
        out = lite.where("outage").agg(F.min("batch_no")).first()[0]
        limit = limit if out is None else min(limit, out)
        asked_now = work.join(due, "batch_no", "left_semi")
        fresh = materialize(routing.candidates(asked_now, lite.drop("outage"), terms, threshold))
        said = materialize(routing.proposed(routing.first_valid(wanted.join(due, "batch_no", "left_semi"), lite.drop("outage"))))
        cands, lite_said, flash = (fresh, said, None) if known is None else (
            materialize(known[0].join(due, "batch_no", "left_anti").unionByName(fresh)),
            materialize(known[1].join(due, "batch_no", "left_anti").unionByName(said)),
            known[2].join(due, "batch_no", "left_anti"),
        )
        live = work.where(F.col("batch_no") < limit)
        capped = materialize(routing.cap_escalation(cands.where(F.col("batch_no") < limit), cap))
        sent = materialize(_sent(live, capped).select("batch_no", "payload"))
        # Replies to other items than those now escalated are of no use.
        unsent = sent if flash is None else sent.join(flash, ["batch_no", "payload"], "left_anti")
        replies = score_batches(unsent, call, FLASH_MODEL, growth, 1).join(unsent, "batch_no").drop("attempt")
        flash = materialize(replies if flash is None else replies.unionByName(flash.join(sent, ["batch_no", "payload"], "left_semi")))
        out = flash.where("outage").agg(F.min("batch_no")).first()[0]
        if out is not None and out < limit:
            limit = out
            live, capped = work.where(F.col("batch_no") < limit), capped.where(F.col("batch_no") < limit)
        answered = flash.where(~F.col("outage")).select("batch_no", "raw")
        results = materialize(routing.settle(live, capped, answered, threshold))
        confirmed = results.where("registers_vocab").groupBy(F.col("canon_name").alias("term")).agg(F.min("batch_no").alias("since"))
        grown = materialize(start.withColumn("since", F.lit(-1).cast("bigint")).unionByName(confirmed).groupBy("term").agg(F.min("since").alias("since")))
        # Who proposed a term that is known to them now and was not, or the other way round?
        flash_said = routing.proposed(routing.parse_replies(answered))
        before = terms.select("term", F.col("since").alias("_before"))
        is_known = lambda c: F.coalesce(F.col(c) < F.col("batch_no"), F.lit(False))
        judged = lite_said.unionByName(flash_said).join(before, "term", "left").join(grown, "term", "left")
        due = materialize(judged.where((is_known("_before") != is_known("since")) & (F.col("batch_no") < limit)).select("batch_no").distinct())
        terms, known = grown, (cands, lite_said, flash)
        if due.isEmpty():
            break
        growth = Growth(seed, tuple((r.since, r.term) for r in terms.where("since >= 0").collect()))
    if limit < no_outage:
        later = work.where(F.col("batch_no") >= limit)
        results = results.unionByName(routing.deferred(later, later.select("batch_no")))
    return results, terms.select("term")
