"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import WORD, null_last, running_total, set_aside
from upswell.operators.ranking import global_rank
from upswell.session import materialize


def words(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(sources: DataFrame, total: float, most: float) -> DataFrame:
    """Adds ``target``: ``total`` shared by ``weight``, at most ``most`` times ``source_size``.

    What a full source leaves is shared again among the others, until none is above. A
    source is full when weight * level exceeds its cap; every round computes the level
    from one row of sums, and only raises it.
    """
    cap = F.col("source_size") * F.lit(most)
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(over, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full = row["full"]
        level = (total - row["held"]) / row["open"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def document_key() -> Column:
    """One digest of doc_id, text and source; NULLs count as values."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return F.md5(F.concat_ws(":", null_last(F.col("doc_id")), text, null_last(F.col("source"))))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 0,
) -> DataFrame:
    """(doc_id, doc_key, size, source_size, target, copies, taken) of every row.

    The mix has ``share`` times the words of all documents. Sources in code point order,
    NULL last, weigh ``weights`` in turn; see ``fill`` for their targets. Documents are
    shuffled by a seeded digest. In each source a document gets a virtual finish time: the
    source's words up to and including it, divided by the source's target; later copies
    queue behind all first ones. All copies are range-sorted by finish time, and the mix
    is cut where the words reach the budget.

    A document is taken ``most`` times at most. NULL texts have no words, long ones are
    counted whole. Rows that repeat doc_id, source and text are documents of their own: they
    are folded to one row with their number where texts are read, and numbered again, so
    each has its own place in the order. Nothing depends on row order or partitioning, so
    reruns agree. Other columns are not read. An empty table gives no rows.
    """
    folded = docs.select(
        "doc_id",
        null_last(F.col("source")).alias("_source"),
        document_key().alias("doc_key"),
        words(F.col("text")).alias("size"),
    ).groupBy("doc_id", "_source", "doc_key", "size").agg(F.count(F.lit(1)).alias("_rows"))
    sized = materialize(folded.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).drop("_rows"))
    per_source = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(per_source, F.col("_source"), rank="_rank")
    nth = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", nth).drop("_rank"))
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    targets = fill(ranked, share * everything, most)

    # Any engine can compute the digest that shuffles.
    again = F.when(F.col("_nth") > 1, F.concat(F.lit(":"), F.col("_nth").cast("string"))).otherwise(F.lit(""))
    queue = sized.withColumn("_mixed", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_key"), again)))
    queued = running_total(queue, ["_source"], ["_mixed"], "size", "_until")
    turn = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_turn")
    finish = (F.col("_until") + F.col("_turn") * F.col("source_size")) / F.col("target")
    copies = (
        queued.join(targets, "_source")
        .select("*", turn)
        .withColumn("_finish", F.when(F.col("target") > 0, finish).otherwise(F.lit(0.0)))
    )
    placed = running_total(copies, [], ["_finish", "_mixed", "_turn"], "size", "_total")
    taken = F.col("_total") <= F.lit(float(min(share, most) * everything))
    return (
        placed.groupBy("doc_key", "_nth")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
            F.count(F.when(taken, 1)).alias("copies"),
        )
        .select(
            "doc_id",
            "doc_key",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def take(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document twice if taken twice.

    Of rows that repeat doc_id, source and text one is used, as often as all of them are
    taken. Documents without words are not part of a mix.
    """
    taken = mix(docs, **how).where("taken > 0")
    copies = materialize(taken.groupBy(F.col("doc_key").alias("_key")).agg(F.sum("copies").alias("_copies")))
    aside, back = set_aside(docs, ["_key", "_copies", "_n"])
    once = aside.withColumn("_key", document_key()).dropDuplicates(["_key"])
    turns = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    taken = once.join(copies, "_key").withColumn("_n", turns)
    return taken.select(*back(taken))
