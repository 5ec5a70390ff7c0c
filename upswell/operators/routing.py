"""Gates over batched model replies, and the capped escalation to a second tier.

Inputs are tables: ``work(batch_no, pos, id, name)`` with unique ids,
``lite(batch_no, attempt, raw)``, ``flash(batch_no, raw)`` and ``vocab(term)``.
A batch is small by construction (``batch_no`` has a fixed number of ids), so all
grouping is by batch and the whole ladder is one shuffle layout on ``batch_no``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upswell.fixed_values import (
    CANON_FLASH,
    CANON_LITE,
    CONFIDENCE_THRESHOLD,
    DEMOTED,
    ESCALATION_CAP,
    PENDING,
)
from upswell.functions.replies import conf_ok, item_fields, reply_items
from upswell.session import materialize


def parse_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``items``: typed item structs in reply order, NULL for an unusable reply."""
    return replies.withColumn("items", item_fields(reply_items(F.col(raw)))).drop(raw)


def requested_ids(work: DataFrame) -> DataFrame:
    """Sorted ids asked for in every batch."""
    return work.groupBy("batch_no").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _ids_echoed(items: Column, ids: Column) -> Column:
    """The reply echoes exactly the requested set; repeats are allowed."""
    got = F.transform(items, lambda i: i["id"])
    whole = F.forall(got, lambda i: i.isNotNull())
    return F.coalesce(whole & (F.array_sort(F.array_distinct(got)) == ids), F.lit(False))


def gate_ids(requested: DataFrame, parsed: DataFrame) -> DataFrame:
    """Adds ``ids_ok`` to every parsed reply of a requested batch."""
    return parsed.join(requested, "batch_no").withColumn(
        "ids_ok", _ids_echoed(F.col("items"), F.col("ids"))
    ).drop("ids")


def first_valid(requested: DataFrame, lite: DataFrame) -> DataFrame:
    """Adds ``items`` of the first valid attempt; NULL where both attempts are broken.

    Both replies of a batch meet in one row, so choosing needs no further shuffle and
    the second is parsed only where the first failed.
    """
    raw = [F.max(F.when(F.col("attempt") == n, F.col("raw"))).alias(f"_raw{n}") for n in (1, 2)]
    attempts = lite.groupBy("batch_no").agg(*raw)
    parsed = requested.join(attempts, "batch_no", "left").withColumns(
        {f"_items{n}": item_fields(reply_items(F.col(f"_raw{n}"))) for n in (1, 2)}
    )
    items = F.when(_ids_echoed(F.col("_items1"), F.col("ids")), F.col("_items1")).when(
        _ids_echoed(F.col("_items2"), F.col("ids")), F.col("_items2")
    )
    return parsed.withColumn("items", items).drop("_raw1", "_raw2", "_items1", "_items2")


def gate_items(valid: DataFrame, vocab: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """One row per reply item with each gate's outcome and ``passed``.

    ``shape_ok``: a usable term. ``vocab_ok``: an allowed one, not proposed as new.
    ``conf_ok``: confident enough. If ``vocab`` has ``since``, a term is allowed in the
    batches after that one.
    """
    item = valid.select("batch_no", F.explode("items").alias("i")).select("batch_no", "i.*")
    since = F.col("since") if "since" in vocab.columns else F.lit(-1)
    allowed = vocab.select(F.col("term").alias("canonical"), since.alias("_since"))
    known = item.join(allowed, "canonical", "left")
    return known.select(
        "batch_no",
        "pos",
        "id",
        "canonical",
        "confidence",
        "is_new",
        F.col("canonical").isNotNull().alias("shape_ok"),
        (F.coalesce(F.col("_since") < F.col("batch_no"), F.lit(False)) & ~F.col("is_new")).alias("vocab_ok"),
        conf_ok(F.col("confidence"), threshold).alias("conf_ok"),
    ).withColumn("passed", F.col("shape_ok") & F.col("vocab_ok") & F.col("conf_ok"))


def proposed(valid: DataFrame) -> DataFrame:
    """``batch_no, term``: every term that the replies with ``items`` propose."""
    terms = valid.select("batch_no", F.explode("items.canonical").alias("term"))
    return terms.where(F.col("term").isNotNull()).distinct()


def candidates(
    work: DataFrame,
    lite: DataFrame,
    vocab: DataFrame,
    threshold: float = CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """First-tier outcome per id: accepted, or its place in the batch's escalation list.

    The list follows reply order on a valid batch and input order on a broken one.
    When a reply repeats an id, escalation wins over acceptance and the last
    proposal counts; every repeat takes a place in the list.
    """
    asked = work.groupBy("batch_no").agg(
        F.array_sort(F.collect_set("id")).alias("ids"),
        F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "id"))).alias("_asked"),
    )
    # A broken batch stands in with its input items, none of which has a proposal.
    blank = F.transform(
        "_asked",
        lambda i: F.struct(
            i["pos"].alias("pos"),
            i["id"].alias("id"),
            F.lit(None).cast("string").alias("canonical"),
            F.lit(None).cast("double").alias("confidence"),
            F.lit(False).alias("is_new"),
        ),
    )
    entries = first_valid(asked, lite).select("batch_no", F.coalesce("items", blank).alias("items"))
    seen = gate_items(entries, vocab, threshold).select(
        "batch_no", "pos", "id", "canonical", "confidence", "passed"
    )
    failed = ~F.col("passed")
    # Replies repeat ids at most as often as the model wrote them into one batch.
    place = F.sum(failed.cast("int")).over(Window.partitionBy("batch_no").orderBy("pos"))
    placed = seen.withColumn("_place", F.when(failed, place))
    return placed.groupBy("batch_no", "id").agg(
        F.min("_place").alias("place"),
        F.max_by(F.struct("canonical", "confidence"), F.when(F.col("passed"), F.col("pos"))).alias("lite"),
        F.max_by("canonical", F.when(failed & F.col("canonical").isNotNull(), F.col("pos"))).alias("lite_canon"),
    )


def escalation_budget(cands: DataFrame, cap: int = ESCALATION_CAP) -> DataFrame:
    """Places granted per batch, in batch order, until ``cap`` ids have been used.

    Every batch with an escalation uses at least one id while budget is left, so the
    first ``cap`` such batches decide everything; the fold below sees no more.
    """
    lists = cands.where(F.col("place").isNotNull()).groupBy("batch_no").agg(
        F.array_sort(F.collect_list("place")).alias("places")
    )
    head = lists.orderBy("batch_no").limit(cap)
    ordered = head.agg(F.array_sort(F.collect_list(F.struct("batch_no", "places"))).alias("all"))
    no_grants = F.array().cast("array<struct<batch_no:bigint,granted:int>>")

    def spend(state: Column, batch: Column) -> Column:
        left = state["left"]
        used = F.size(F.filter(batch["places"], lambda p: p <= left))
        grant = F.struct(batch["batch_no"].cast("bigint").alias("batch_no"), left.alias("granted"))
        return F.struct(
            (left - used).alias("left"), F.array_append(state["grants"], grant).alias("grants")
        )

    start = F.struct(F.lit(int(cap)).alias("left"), no_grants.alias("grants"))
    grants = ordered.select(F.explode(F.aggregate("all", start, spend)["grants"]).alias("g"))
    return grants.select("g.*").where(F.col("granted") > 0)


def cap_escalation(cands: DataFrame, cap: int = ESCALATION_CAP) -> DataFrame:
    """Adds ``escalated``: true within the budget, false beyond it, NULL if accepted."""
    budget = escalation_budget(cands, cap)
    within = F.col("place") <= F.coalesce("granted", F.lit(0))
    return cands.join(budget, "batch_no", "left").withColumn("escalated", within).drop("granted")


def accept_flash(capped: DataFrame, flash: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Second-tier outcome of every escalated id; the vocabulary is not checked again.

    A reply that does not echo the escalated ids demotes its whole batch.
    """
    sent = capped.where(F.col("escalated")).select("batch_no", "id")
    valid = gate_ids(requested_ids(sent), parse_replies(flash)).where(F.col("ids_ok"))
    item = valid.select("batch_no", F.explode("items").alias("i")).select("batch_no", "i.*")
    last = item.groupBy("batch_no", "id").agg(
        F.max_by(F.struct("canonical", "confidence", "is_new"), F.col("pos")).alias("r")
    )
    good = F.col("r.canonical").isNotNull() & conf_ok(F.col("r.confidence"), threshold)
    return sent.join(last, ["batch_no", "id"], "left").select(
        "batch_no",
        "id",
        F.when(F.coalesce(good, F.lit(False)), F.col("r")).alias("flash"),
    )


def final_status(work: DataFrame, capped: DataFrame, confirmed: DataFrame) -> DataFrame:
    """One row per work item: status, accepted term, and the log of both proposals."""
    joined = work.join(capped, ["batch_no", "id"], "left").join(confirmed, ["batch_no", "id"], "left")
    status = (
        F.when(F.col("escalated") & F.col("flash").isNotNull(), CANON_FLASH)
        .when(F.col("escalated"), DEMOTED)
        .when(~F.col("escalated"), PENDING)
        .when(F.col("lite").isNotNull(), CANON_LITE)
        .otherwise(PENDING)
    )
    chosen = F.when(F.col("escalated").isNull(), F.col("lite.canonical")).otherwise(F.col("flash.canonical"))
    sure = F.when(F.col("escalated").isNull(), F.col("lite.confidence")).otherwise(F.col("flash.confidence"))
    return joined.select(
        "batch_no",
        "pos",
        "id",
        status.alias("status"),
        chosen.alias("canon_name"),
        sure.alias("confidence"),
        F.coalesce(F.col("flash.is_new"), F.lit(False)).alias("registers_vocab"),
        F.when(F.col("escalated"), F.col("lite_canon")).alias("lite_canon"),
    )


def before_outage(work: DataFrame, outages: DataFrame) -> DataFrame:
    """Work of the batches before the first outage."""
    first = outages.agg(F.min("batch_no")).scalar()
    return work.where(F.coalesce(F.col("batch_no") < first, F.lit(True)))


def deferred(work: DataFrame, outages: DataFrame) -> DataFrame:
    """Results of the batch hit by the first outage and of all later ones: pending."""
    first = outages.agg(F.min("batch_no")).scalar()
    return work.where(F.col("batch_no") >= first).select(
        "batch_no",
        "pos",
        "id",
        F.lit(PENDING).alias("status"),
        F.lit(None).cast("string").alias("canon_name"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(False).alias("registers_vocab"),
        F.lit(None).cast("string").alias("lite_canon"),
    )


def escalate(
    work: DataFrame,
    lite: DataFrame,
    vocab: DataFrame,
    threshold: float = CONFIDENCE_THRESHOLD,
    cap: int = ESCALATION_CAP,
) -> DataFrame:
    """First half of the ladder. Its candidates are stored, so replies are parsed once."""
    return cap_escalation(materialize(candidates(work, lite, vocab, threshold)), cap)


def settle(
    work: DataFrame, capped: DataFrame, flash: DataFrame, threshold: float = CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Second half: one result per work item."""
    return final_status(work, capped, accept_flash(capped, flash, threshold))


def route(
    work: DataFrame,
    lite: DataFrame,
    flash: DataFrame,
    vocab: DataFrame,
    threshold: float = CONFIDENCE_THRESHOLD,
    cap: int = ESCALATION_CAP,
    outages: DataFrame | None = None,
) -> DataFrame:
    """The whole ladder for replies already at hand, with a fixed vocabulary."""
    live = work if outages is None else before_outage(work, outages)
    results = settle(live, escalate(live, lite, vocab, threshold, cap), flash, threshold)
    return results if outages is None else results.unionByName(deferred(work, outages))


def escalation_log(results: DataFrame, run: Column) -> DataFrame:
    """Rows to append per run, so that the agreement of both tiers can be queried."""
    return results.where(F.col("status").isin(CANON_FLASH, DEMOTED)).select(
        run.alias("run"), "id", "status", "canon_name", "lite_canon"
    )


def new_terms(results: DataFrame) -> DataFrame:
    """Confirmed new terms, which later batches may use."""
    return results.where(F.col("registers_vocab")).select(F.col("canon_name").alias("term")).distinct()
