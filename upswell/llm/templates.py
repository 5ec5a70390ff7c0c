"""Line deduplication by a fixed-depth tree of line templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import set_aside
from upswell.session import materialize

#: What stands for a variable field.
FIELD = "<*>"
_SPACE = r"[\x20\x09-\x0D]"
_SOLID = r"[^\x20\x09-\x0D]"
#: A token with a digit in it, found from its start without going back.
_NUMBER = rf"(?<!{_SOLID})[^\x20\x09-\x0D0-9]*+[0-9]{_SOLID}*+"


def spaced(line: Column) -> Column:
    """The tokens of a line with one space between. Most lines are so already."""
    other = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for space in "\t\x0b\x0c\r":
        other = other | line.contains(space)
    once = F.regexp_replace(F.regexp_replace(line, f"{_SPACE}+", " "), "^ | $", "")
    return F.when(other, once).otherwise(line)


def masked(tokens: Column) -> Column:
    """Spaced tokens, those with digits as fields."""
    return F.regexp_replace(tokens, _NUMBER, FIELD)


def _key(*columns: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(" ", *columns)))


def lines(docs: DataFrame, leading: int) -> DataFrame:
    """(doc_id, text_key, nth, leaf, tokens) of every line that has tokens.

    A leaf of the tree has the lines with one number of tokens and the same ``leading``
    first tokens, fields among them; leaf and text_key are 128-bit digests.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # The digest is taken before the lines come apart, once per document.
    keyed = docs.select("doc_id", F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    split = keyed.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("nth", "l"))
    tokens = F.col("tokens")
    count = F.octet_length(tokens) - F.octet_length(F.replace(tokens, F.lit(" "), F.lit(""))) + 1
    return (
        split.where(F.col("l").rlike(_SOLID))
        .select("doc_id", "text_key", "nth", spaced(F.col("l")).alias("tokens"))
        .select(
            "doc_id",
            "text_key",
            "nth",
            _key(count.cast("string"), masked(F.substring_index(tokens, " ", leading))).alias("leaf"),
            "tokens",
        )
    )


def line_templates(found: DataFrame, least_docs: int, constant_share: float) -> DataFrame:
    """(line, template) for the distinct lines of recurring leaves whose template is firm.

    Equal lines are folded first and weigh as many texts as have them, so a line that a
    third of all documents shares is one row here. In its leaf, a token is constant at a
    place if the lines that have it there weigh ``least_docs`` or more; other tokens are
    variable fields. Lines with a smaller ``constant_share`` of constant tokens have no
    template.
    """
    weights = (
        found.select("leaf", "line", "text_key").distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("w"))
    )
    texts = found.groupBy("line").agg(F.first("masked").alias("masked"))
    tokens = materialize(
        weights.join(texts, "line").select(
            "leaf", "line", "w", F.posexplode(F.split("masked", " ")).alias("place", "token")
        )
    )
    # Written before the join, so that adaptive execution can split a frequent token there.
    constant = materialize(
        tokens.groupBy("leaf", "place", "token")
        .agg(F.sum("w").alias("w"))
        .where((F.col("w") >= least_docs) & (F.col("token") != FIELD))
        .select("leaf", "place", "token", F.lit(True).alias("constant"))
    )
    part = F.when(F.col("constant"), F.col("token")).otherwise(F.lit(FIELD))
    put = F.sort_array(F.collect_list(F.struct("place", part.alias("part"))))
    return (
        tokens.join(constant, ["leaf", "place", "token"], "left")
        .groupBy("leaf", "line")
        .agg(put.alias("parts"), F.count("constant").alias("constants"))
        .where(F.col("constants") >= F.lit(constant_share) * F.size("parts"))
        .select("line", F.array_join("parts.part", " ").alias("template"))
    )


def recurring_lines(
    docs: DataFrame, least_docs: int = 5, leading: int = 2, constant_share: float = 0.5
) -> DataFrame:
    """(doc_id, text_key, nth, template) of the lines whose template recurs across documents.

    A template recurs if ``least_docs`` different texts have lines of it; equal texts
    count once, so copies of a document do not turn its prose into a template. A line with
    too few tokens without digits for any template is its own template, digits and all: it
    recurs where it stands unchanged.
    """
    every = lines(docs, leading)
    leaves = materialize(
        every.select("leaf", "text_key")
        .distinct()
        .groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") >= least_docs)
        .select("leaf")
    )
    # Whole lines are masked where their leaf recurs, and only there.
    held = every.join(leaves, "leaf", "left_semi").withColumn("masked", masked(F.col("tokens")))
    words = F.filter(F.split("masked", " "), lambda t: t != FIELD)
    numeric = F.size(words) < F.lit(constant_share) * F.size(F.split("masked", " "))
    # Few lines are mostly numbers: only these keep their text beside the masked one.
    held = held.withColumn("literal", F.when(F.col("masked").contains(FIELD) & numeric, F.col("tokens"))).drop("tokens")
    found = materialize(held.withColumn("line", _key(F.col("masked"))))
    template = line_templates(found, least_docs, constant_share)
    template = template.select("line", _key(F.col("template")).alias("template_key"), "template")
    unchanged = found.where(F.col("literal").isNotNull()).withColumn("template_key", _key(F.lit("="), F.col("literal")))
    unchanged = unchanged.select("line", "doc_id", "text_key", "nth", "template_key", F.col("literal").alias("template"))
    matched = found.drop("masked", "leaf", "literal").join(template, "line")
    matched = materialize(matched.select(unchanged.columns).unionByName(unchanged))
    recurring = materialize(
        matched.select("template_key", "text_key")
        .distinct()
        .groupBy("template_key")
        .agg(F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") >= least_docs)
        .select("template_key")
    )
    return matched.join(recurring, "template_key", "left_semi").select("doc_id", "text_key", "nth", "template")


def drop_recurring_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the recurring lines taken out of text, and n_lines and n_dropped.

    Lines end at line feeds. Lines without tokens stay. All lines of a recurring template
    go, in every document. A NULL text stays NULL and has no lines; an empty one has one
    line. Rows that repeat doc_id and text are treated alike and stay as many. All other
    columns stay; n_lines and n_dropped replace columns of these names. An empty table
    gives no rows.
    """
    gone = (
        recurring_lines(docs, **how)
        .select("doc_id", "text_key", "nth")
        .distinct()
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"))
        .agg(F.collect_list("nth").alias("_gone"))
    )
    text_key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key == F.col("_text"))
    kept, back = set_aside(docs.drop("n_lines", "n_dropped"), gone.columns)
    split = F.split("text", "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone"))
    rest = F.array_join(F.transform(stays, lambda i: F.get(split, i)), "\n")
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    counted = kept.join(gone, same, "left").withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(breaks + 1).cast("long"),
            "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        }
    )
    cut = counted.withColumn("text", F.when(F.col("_gone").isNotNull(), rest).otherwise(F.col("text")))
    return cut.select(*back(cut), "n_lines", "n_dropped")
