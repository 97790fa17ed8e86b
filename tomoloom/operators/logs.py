"""Search keywords from agent logs: one JSON event per line, with web calls written inside its strings.

Lines are never moved until the few keywords found are deduplicated. Nearly every step is a column expression; Python only
walks lines that repeat a key, and matches parentheses in the few texts that hold a call.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tomoloom.functions.storage import materialize
from tomoloom.functions.text import is_sealed_blob, strip

# The call looked for, the lists and fields read from its argument, the shortest string considered.
CALL = "tools.web__run"
FIELDS = (("query", "search_query", "q"), ("pattern", "find", "pattern"))
SHORTEST = 20
BLOCK_MARK = "---\n"
#: Texts of a batch that are Python objects at a time.
LINES_AT_ONCE = 64

_CALL, _PARENTHESIS = re.compile(re.escape(CALL)), re.compile("[()]")
_OPENING = re.compile(r"[^(\n]*\(")

# Stand-ins for escaped backslash and quote; a JSON string cannot hold these characters unescaped.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def json_value(text: Column) -> Column:
    """Text as VARIANT if it is exactly one JSON value, else null.

    The parser ignores what follows the first value. Nothing but a single value is valid both as the only element of
    an array and as the only field of an object.
    """
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(as_element.isNotNull(), F.try_variant_get(as_field, "$.v", "variant"))


def _flat(text: Column) -> Column:
    """Text whose only quotes are those around its strings."""
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _unflat(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def plain_numbers(text: Column) -> Column:
    """Text with null in place of NaN and infinities outside its strings, which the parser does not know."""
    parts = F.split(_flat(text), '"', -1)
    outside = F.transform(parts, lambda s, i: F.when(i % 2 == 0, F.regexp_replace(s, "-?Infinity|NaN", "null")).otherwise(s))
    return F.when(F.rlike(text, F.lit("NaN|Infinity")), _unflat(F.array_join(outside, '"'))).otherwise(text)


def string_literals(line: Column) -> Column:
    """The quoted string values of a JSON text, depth first in source order, object keys left out."""
    literals = F.regexp_extract_all(_flat(line), F.lit(r'"[^"]*"(?:\s*:)?'), F.lit(0))
    return F.transform(F.filter(literals, lambda s: ~s.endswith(":")), _unflat)


def decode_literal(literal: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(literal), "$", "string")


def repeats_a_key(line: Column) -> Column:
    """Whether two keys of a JSON text are written alike, in one object or in several."""
    keys = F.regexp_extract_all(_flat(line), F.lit(r'"[^"]*"\s*:'), F.lit(0))
    return F.size(F.array_distinct(F.transform(keys, lambda k: F.rtrim(F.rtrim(k), F.lit(":"))))) < F.size(keys)


def _walk(value, out: list[str]) -> None:
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, dict | list):
        for part in value.values() if isinstance(value, dict) else value:
            _walk(part, out)


def _listed(texts: pa.Array, find: Callable[[str], list[str | None]]) -> pa.Array:
    """What `find` gives for each text, null for null; Python holds the texts of a few lines at a time."""
    kind = pa.list_(pa.string())
    parts = []
    for low in range(0, len(texts), LINES_AT_ONCE):
        some = texts.slice(low, LINES_AT_ONCE).to_pylist()
        parts.append(pa.array([None if t is None else find(t) for t in some], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _last_members(line: str) -> list[str | None]:
    strings: list[str] = []
    try:
        _walk(json.loads(line), strings)
    except (ValueError, RecursionError):
        strings = []
    return [s.encode("utf-8", "replace").decode() for s in strings]


@F.arrow_udf(ArrayType(StringType()))
def _strings_of_last_members(lines: pa.Array) -> pa.Array:
    """Strings of JSON texts in which a key may be repeated: its last value stands at its first place."""
    return _listed(lines, _last_members)


def json_strings(events: DataFrame, line: str = "line") -> DataFrame:
    """All string values of each JSON line as `(…, str_no, text)`; lines that are not JSON give none.

    NaN and infinities are read as numbers. Where an object repeats a key only its last value counts; such lines, and
    those whose objects share a key, are walked in Python, all others by expressions.
    """
    kept = [c for c in events.columns if c != line]
    text = plain_numbers(strip(F.col(line)))
    read = events.select(*kept, text.alias("_line")).withColumn("_twice", repeats_a_key(F.col("_line")))
    valid = read.filter(F.col("_twice") | json_value(F.col("_line")).isNotNull())
    walked = _strings_of_last_members(F.when(F.col("_twice"), F.col("_line")))
    simple = F.transform(string_literals(F.col("_line")), decode_literal)
    strings = valid.select(*kept, F.when(F.col("_twice"), walked).otherwise(simple).alias("_strings"))
    return strings.select(*kept, F.posexplode("_strings").alias("str_no", "text"))


def candidate_strings(strings: DataFrame, text: str = "text") -> DataFrame:
    """Stripped strings long enough to hold a call and not an encoded payload."""
    stripped = strings.withColumn(text, strip(F.col(text)))
    return stripped.filter(F.length(text) >= SHORTEST).filter(~is_sealed_blob(F.col(text)))


def _enclosed(text: str) -> list[str | None]:
    """For each occurrence of the call name, what the first parenthesis after it encloses; one pass over the text.

    None if there is no parenthesis before a line break, or it is never closed. A parenthesis in a quoted string counts.
    """
    closes, open_ = {}, []
    for mark in _PARENTHESIS.finditer(text):
        if mark[0] == "(":
            open_.append(mark.start())
        elif open_:
            closes[open_.pop()] = mark.start()
    found = []
    for call in _CALL.finditer(text):
        start = _OPENING.match(text, call.end())
        stop = closes.get(start.end() - 1) if start else None
        found.append(None if stop is None else text[start.end() : stop])
    return found


@F.arrow_udf(ArrayType(StringType()))
def call_arguments(texts: pa.Array) -> pa.Array:
    return _listed(texts, _enclosed)


def web_calls(events: DataFrame, line: str = "line") -> DataFrame:
    """The JSON object argument of each call: `(…, str_no, call_no, argument VARIANT)`.

    Lines that cannot hold a call are dropped before any parsing: the name appears as it is, or hidden behind an
    escape sequence.
    """
    possible = F.contains(F.col(line), F.lit(CALL)) | F.contains(F.col(line), F.lit("\\"))
    kept = [c for c in events.columns if c != line]
    texts = candidate_strings(json_strings(events.filter(possible), line)).filter(
        F.contains(F.col("text"), F.lit(CALL))
    )
    found = texts.select(*kept, "str_no", F.posexplode(call_arguments(F.col("text"))).alias("call_no", "_argument"))
    calls = found.select(*kept, "str_no", "call_no", json_value(plain_numbers(F.col("_argument"))).alias("argument"))
    return calls.filter(F.startswith(F.schema_of_variant("argument"), F.lit("OBJECT")))


def call_keywords(calls: DataFrame) -> DataFrame:
    """Every search query and find pattern of each call: `(…, kind, item_no, text)`.

    List elements that are not objects, and empty texts, are passed over.
    """
    kept = [c for c in calls.columns if c != "argument"]

    def items(kind: str, path: str, field: str) -> Column:
        listed = F.try_variant_get("argument", f"$.{path}", "array<variant>")
        return F.transform(
            F.coalesce(listed, F.array().cast("array<variant>")),
            lambda e, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("item_no"),
                F.try_variant_get(e, f"$.{field}", "string").alias("text"),
            ),
        )

    return calls.select(*kept, F.inline(F.concat(*(items(*f) for f in FIELDS)))).filter(F.col("text") != "")


def keywords(events: DataFrame, line: str = "line", at: str = "at") -> DataFrame:
    """Distinct keywords with the place of the line each was first seen on: `(kind, at, text, seen)`.

    `at` is any sortable column that places a line in the log: a number, or a structure such as that of
    `sources.files.log_lines`. `seen` sorts keywords of a kind by first appearance. The same text may appear once in
    each kind.
    """
    found = call_keywords(web_calls(events.select(at, line), line))
    distinct = found.groupBy("kind", "text").agg(
        F.min(F.struct(at, "str_no", "call_no", "item_no")).alias("seen")
    )
    return distinct.select("kind", F.col(f"seen.{at}").alias(at), "text", "seen")


def in_order(found: DataFrame) -> DataFrame:
    """Queries, then patterns, each by first appearance."""
    return found.orderBy(_kind_order(), "seen")


def _kind_order() -> Column:
    return F.when(F.col("kind") == FIELDS[0][0], 0).otherwise(1)


def keyword_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("keywords"))


def write_keyword_blocks(found: DataFrame, path: str) -> None:
    """Keyword texts as blocks separated by a `---` line, in order over the part files. Nothing found is an error."""
    found = materialize(found)
    if found.isEmpty():
        raise ValueError("no web search or find calls found in this log")
    # The separator stands before every block but the first, so the file ends in a line break only.
    first = materialize(in_order(found).limit(1).select("kind", "text", F.lit(True).alias("_first")))
    marked = found.join(first, ["kind", "text"], "left")
    block = F.when(F.col("_first"), F.col("text")).otherwise(F.concat(F.lit(BLOCK_MARK), "text"))
    in_order(marked.withColumn("text", block)).select("text").write.text(path)
