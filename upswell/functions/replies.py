"""Reading model replies: JSON text of unknown shape, handled as VARIANT values.

The type of a value decides a gate (a numeric *string* is no confidence), so the
fields stay VARIANT until their type has been looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space around a reply.
_BLANK = r"(?U)[\s\x1c-\x1f]"
_JSON = {"allowSingleQuotes": "false"}


def _type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is_number(value: Column) -> Column:
    kind = _type(value)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _json(text: Column) -> Column:
    """One whole JSON value, or NULL.

    The reader stops after the first value and ignores what follows. Only a text
    that is a single value parses both as an array element and as an object member;
    most broken texts fail the first form and are not parsed again.
    """
    element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "variant", _JSON)
    member = F.from_json(F.concat(F.lit('{"r":'), text, F.lit("}")), "variant", _JSON)
    return F.when(element.isNotNull(), F.try_variant_get(member, "$.r", "variant"))


def reply_body(raw: Column) -> Column:
    """Reply without surrounding blanks and without a code fence."""

    def unfenced(text: Column) -> Column:
        inside = F.get(F.split(text, "```"), F.lit(1))
        inside = F.when(inside.startswith("json"), F.substr(inside, F.lit(5))).otherwise(inside)
        return F.when(text.startswith("```"), inside).otherwise(text)

    return _let(F.regexp_replace(raw, f"^{_BLANK}+|{_BLANK}+$", ""), unfenced)


def _elements(data: Column) -> Column:
    """The items of a reply as maps: a list, or the ``items`` of an object; NULL for anything else.

    An element that is no object becomes a NULL map.
    """
    kind = "array<map<string,variant>>"
    return F.coalesce(F.try_variant_get(data, "$", kind), F.try_variant_get(data, "$.items", kind))


def _all_objects(items: Column) -> Column:
    objects = F.forall(items, lambda v: v.isNotNull())
    return F.when(F.coalesce(objects, F.lit(False)), items)


def reply_items(raw: Column) -> Column:
    """Array of item objects, or NULL when the reply as a whole is unusable.

    Accepts ``{"items": [...]}`` or a bare array, all of whose elements are objects.
    """
    return _let(_let(_let(reply_body(raw), _json), _elements), _all_objects)


def _field(item: Column, name: str, body: Callable[[Column], Column]) -> Column:
    return _let(item[name], body)


def _flag(value: Column) -> Column:
    return F.when(_type(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def item_id(item: Column) -> Column:
    """Echoed id as a BIGINT; NULL when it is missing or no whole number."""

    def whole(value: Column) -> Column:
        number = F.try_variant_get(value, "$", "decimal(38,10)")
        exact = F.when(_is_number(value) & (number == F.floor(number)), number.try_cast("bigint"))
        return F.coalesce(_flag(value).cast("bigint"), exact)

    return _field(item, "id", whole)


def item_canonical(item: Column) -> Column:
    """Proposed term if it is a string with something in it, else NULL."""

    def term(value: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        return F.when((_type(value) == "STRING") & ~text.rlike(f"^{_BLANK}*$"), text)

    return _field(item, "canonical", term)


def item_is_new(item: Column) -> Column:
    """Truth value of the flag: 0, "", [], {}, null and false are false, the rest true."""

    def truth(value: Column) -> Column:
        number = F.try_variant_get(value, "$", "double")
        empty = F.to_json(value).isin("null", "false", '""', "[]", "{}")
        return F.when(_is_number(value), number != 0).otherwise(~empty)

    return F.coalesce(_field(item, "is_new", truth), F.lit(False))


def item_confidence(item: Column) -> Column:
    """Confidence as a double if it is a JSON number or boolean, else NULL."""

    def number(value: Column) -> Column:
        plain = F.when(_is_number(value), F.try_variant_get(value, "$", "double"))
        return F.coalesce(plain, _flag(value).cast("int").cast("double"))

    return _field(item, "confidence", number)


def item_fields(items: Column) -> Column:
    """Array of typed structs ``(pos, id, canonical, confidence, is_new)`` in reply order."""
    return F.transform(
        items,
        lambda v, i: F.struct(
            (i + 1).alias("pos"),
            item_id(v).alias("id"),
            item_canonical(v).alias("canonical"),
            item_confidence(v).alias("confidence"),
            item_is_new(v).alias("is_new"),
        ),
    )


def conf_ok(confidence: Column, threshold: float) -> Column:
    """A known confidence at or above the threshold; NaN passes."""
    return F.coalesce(confidence >= F.lit(float(threshold)), F.lit(False))
