"""Log message parsers as column expressions.

Each parser maps a message to a ``map<string, variant>`` body, or null when the
message is not in its format.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, functions as F

from tidemark.schemas import DEFAULT_NAMING, Naming

BODY_TYPE = "map<string,variant>"

# A token of the key=value format: plain characters, or a quoted run whose end
# quote is not escaped; an unclosed quote runs to the end of the message.
KEY_VALUE_TOKEN = (
    r"""(?Us)(?:[^\s"'\\]++|\\["']?|"(?:[^"\\]++|\\"?)*+(?:"|$)|'(?:[^'\\]++|\\'?)*+(?:'|$))++"""
)


def _text_body(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, F.transform(values, lambda v: v.cast("variant")))


def empty_body() -> Column:
    return F.create_map().cast(BODY_TYPE)


def message_body(msg: Column, naming: Naming = DEFAULT_NAMING) -> Column:
    """Raw text under the message key."""
    return F.create_map(F.lit(naming.message_key), msg.cast("variant"))


def body_text(body: Column, key: str | Column) -> Column:
    """Text form of one body value; empty when the key is absent or null."""
    return F.coalesce(body[key].cast("string"), F.lit(""))


def unquote(c: Column) -> Column:
    """Drop one pair of matching quotes around the text."""
    quoted = F.lit(False)
    for mark in ('"', "'"):
        quoted = quoted | (c.startswith(mark) & c.endswith(mark))
    return F.when(quoted & (F.length(c) >= 2), c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)


def fields_of(c: Column) -> Column:
    """Non-empty parts between runs of white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


END_MARK = "\u241e end"


def strict_json(c: Column) -> Column:
    """Variant of a text that is one complete JSON value, else null.

    The variant parser ignores what follows the first value. Reading the text as
    the first member of a list whose second member is a mark shows that nothing
    followed it.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{END_MARK}"]')))
    whole = F.try_variant_get(listed, "$[1]", "string") == END_MARK
    return F.when(whole, F.try_variant_get(listed, "$[0]", "variant"))


def json_body(msg: Column) -> Column:
    """Object messages; anything that does not start with a brace or is not valid JSON is null."""
    return F.when(msg.startswith("{"), strict_json(msg).cast(BODY_TYPE))


def typed_value(text: Column) -> Column:
    """Variant holding a boolean, integer or decimal number when the text is one, else the text."""
    number = F.when(text.contains("."), text.try_cast("double").cast("variant")).otherwise(
        text.try_cast("bigint").cast("variant")
    )
    return (
        F.when(text.rlike(r"^[+-]?[0-9]*\.?[0-9]*$"), F.coalesce(number, text.cast("variant")))
        .when(F.lower(text).isin("true", "false"), (F.lower(text) == "true").cast("variant"))
        .otherwise(text.cast("variant"))
    )


def keyvalue_body(msg: Column) -> Column:
    """``key=value`` and bare ``key`` tokens; quotes group words, values are typed."""
    tokens = F.regexp_extract_all(msg, F.lit(KEY_VALUE_TOKEN), F.lit(0))
    sides = F.transform(tokens, lambda t: F.split(t, "=", 2))
    pairs = F.transform(
        sides,
        lambda s: F.struct(F.get(s, F.lit(0)).alias("key"), unquote(F.coalesce(F.get(s, F.lit(1)), F.lit(""))).alias("text")),
    )
    return F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), typed_value(p["text"]).alias("value")))
    )


def klog_body(msg: Column) -> Column:
    """Header up to ``]``, quoted message, then ``key=value`` pairs; degrades to the message alone."""
    text = trim_space(msg)
    header_end = F.instr(text, "]")
    header = fields_of(F.substring_index(text, "]", 1))
    rest = trim_space(text.substr(header_end + 1, F.length(text)))
    where = F.split(F.get(header, F.lit(3)), ":")
    parts = F.split(rest, '"', 3)

    def entry(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    none = F.array().cast("array<struct<key:string,value:string>>")
    stamp = F.when(F.size(header) >= 4, F.array(entry("timestamp", F.get(header, F.lit(1))))).otherwise(none)
    place = F.when(
        (F.size(header) >= 4) & (F.size(where) == 2),
        F.array(entry("filename", F.get(where, F.lit(0))), entry("line_number", F.get(where, F.lit(1)))),
    ).otherwise(none)
    pairs = F.transform(
        F.filter(fields_of(F.coalesce(F.get(parts, F.lit(2)), F.lit(""))), lambda p: p.contains("=")),
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            unquote(p.substr(F.instr(p, "=") + 1, F.length(p))).alias("value"),
        ),
    )
    structured = F.concat(F.array(entry("message", F.get(parts, F.lit(1)))), pairs)
    tail = F.when(F.size(parts) == 3, structured).otherwise(F.array(entry("message", rest)))
    all_entries = (
        F.when(text == "", none)
        .when(header_end == 0, F.array(entry("message", text)))
        .otherwise(F.concat(stamp, place, tail))
    )
    return F.map_from_entries(
        F.transform(all_entries, lambda e: F.struct(e["key"].alias("key"), e["value"].cast("variant").alias("value")))
    )


def space_body(msg: Column) -> Column:
    """``field0``, ``field1``, … of the parts between white space."""
    parts = fields_of(msg)
    keys = F.transform(parts, lambda _, i: F.concat(F.lit("field"), i.cast("string")))
    return _text_body(keys, parts)


# Parser names a configuration may use. Fixed values.
PARSERS = {"json": json_body, "keyvalue": keyvalue_body, "klog": klog_body, "space": space_body}


def parse_message(msg: Column, parsers: list[str], naming: Naming = DEFAULT_NAMING) -> Column:
    """Body from the first parser that accepts the message, else the raw text."""
    chain = []
    for name in parsers:
        if name in PARSERS:
            chain.append(PARSERS[name](msg))
        else:
            warnings.warn(f"unknown message parser skipped: {name}", stacklevel=2)
    return F.coalesce(*chain, message_body(msg, naming)) if chain else message_body(msg, naming)
