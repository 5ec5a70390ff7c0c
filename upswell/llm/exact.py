"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import set_aside
from upswell.session import materialize


def chunks(text, min_chars: int, max_chars: int):
    """Text cut after sentence ends and line ends: array of strings that add up to it.

    A chunk has ``min_chars`` at least (but for the last one) and runs to the next place
    where a sentence or line ends, ``max_chars`` at most. Cuts follow the content, so
    texts that share a passage share most chunks of it.
    """
    pattern = rf"(?s).{{{min_chars - 1},{max_chars - 1}}}?[.!?\n]|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, min_chars: int = 512, max_chars: int = 8192) -> DataFrame:
    """(doc_id, text_sha256, recipe) of every row, its chunks named by two digests.

    The only step that reads texts. What moves afterwards is some 40 bytes per chunk.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(
        docs.select(
            F.col("doc_id"),
            F.sha2(text, 256).alias("text_sha256"),
            F.transform(
                chunks(text, min_chars, max_chars),
                lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest")),
            ).alias("recipe"),
        )
    )


def unverified(found: DataFrame) -> DataFrame:
    """Chunk identifiers that stand for two different chunks: (id); nearly always empty.

    Copies of a chunk are folded in the map tasks: one row per identifier and task moves.
    """
    return (
        found.select(F.explode("recipe").alias("c"))
        .groupBy(F.col("c.id").alias("id"))
        .agg(F.min("c.digest").alias("_low"), F.max("c.digest").alias("_high"))
        .where(F.col("_low") != F.col("_high"))
        .select("id")
    )


def exact_groups(docs: DataFrame, min_chars: int = 512, max_chars: int = 8192) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): which of equal texts stays.

    Texts are cut into content-defined chunks; a chunk's 64-bit identifier is verified
    against its SHA-256 over the whole corpus, and documents are equal when their ordered
    lists of verified identifiers are. The largest doc_id of a group stays.

    A NULL text counts as empty. Every row counts and gives one row, also those that repeat
    a doc_id and text: if theirs is the largest doc_id, all of them stay. A NULL doc_id is
    smaller than any other. Texts of any length are cut into chunks of ``max_chars`` at
    most. Other columns are not read. An empty table gives no rows.
    """
    found = recipes(docs, min_chars, max_chars)
    clashing = materialize(unverified(found))
    # Identifiers that failed give way to the chunk's full digest.
    odd = (
        found.select("doc_id", "text_sha256", F.explode("recipe.id").alias("id"))
        .join(clashing, "id", "left_semi")
        .select("doc_id", "text_sha256", F.lit(True).alias("_odd"))
        .distinct()
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (
        F.col("d.text_sha256") == F.col("o.text_sha256")
    )
    listed = found.alias("d").join(odd.alias("o"), same, "left").select(
        "d.doc_id",
        "d.text_sha256",
        F.col("d.recipe.id").alias("ids"),
        F.when(F.col("_odd"), F.col("d.recipe.digest")).otherwise(F.array()).alias("digests"),
    )
    # Written before the join, so that adaptive execution can split a large group there.
    groups = materialize(
        listed.groupBy("ids", "digests").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
    )
    return listed.join(groups, ["ids", "digests"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no copy with a larger doc_id.

    Rows that repeat both doc_id and text of a document that stays all stay.
    """
    gone = exact_groups(docs, **how).where(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256) == F.col("_gone_text")
    )
    aside, back = set_aside(docs, gone.columns)
    left = aside.join(gone, same, "left_anti")
    return left.select(*back(left))
