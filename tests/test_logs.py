import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomoloom.operators import logs


def events(spark, lines):
    return spark.createDataFrame(list(enumerate(lines, start=1)), "at bigint, line string")


def call(argument):
    return f"await tools.web__run({argument})"


def event(*texts):
    return json.dumps({"type": "event", "payload": {"args": list(texts)}})


def mined(spark, lines):
    found = logs.in_order(logs.keywords(events(spark, lines))).collect()
    return [(r.kind, r.at, r.text) for r in found]


def every_string(value):
    if isinstance(value, str):
        return [value]
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for part in parts for s in every_string(part)]


def matching_close(text):
    """Depth counted character by character."""
    start = text.find("(")
    line_break = text.find("\n")
    if start < 0 or 0 <= line_break < start:
        return None
    depth = 0
    for i in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return text[start + 1 : i]
    return None


def test_strings_in_source_order_without_keys(spark):
    values = [
        {"b": "one", "a": ["two", {"c": "three \"quoted\" \\", "k": 4}], "z": None},
        ["\\\\", "\"", "tab\tnew\nline", "ünï ☃ \U0001f600", ":", "x:", " : "],
        {"key : ": "a\"b\" : c", "": ""},
        "alone",
        {"deep": [[[["x"], "y"]], {"p": {"q": {"r": "z"}}}]},
    ]
    for ascii_only in (True, False):
        lines = [json.dumps(v, ensure_ascii=ascii_only, indent=None if ascii_only else 1) for v in values]
        found = logs.json_strings(events(spark, lines)).orderBy("at", "str_no").collect()
        for number, value in enumerate(values, start=1):
            assert [r.text for r in found if r.at == number] == every_string(value)


@pytest.mark.parametrize(
    "line",
    ["", "   ", "{", '{"a": "text"} x', '{"a":"x"}, {"b":"y"}', '"a", "b"', '"a","b":"c"', '"a"}', '"a"], ["b"', "plain"],
)
def test_text_that_is_not_one_json_value_gives_nothing(spark, line):
    assert logs.json_strings(events(spark, [line])).count() == 0


@pytest.mark.parametrize(
    "tail",
    ["(a)", "  (a(b)c)(d)", "(a", "a)", "x\n(a)", " = (((1)(2)))) ", "(\n)", "()", "(()", '("a)b")', "((a)(b(c)))z)", ""],
)
def test_balanced_argument(spark, tail):
    frame = spark.createDataFrame([(f"x {logs.CALL}{tail}",)], "t string")
    assert frame.select(logs.call_arguments(F.col("t")).alias("a")).first()["a"] == [matching_close(tail)]


def test_several_calls_nested_and_unclosed(spark):
    text = f") {logs.CALL}(a {logs.CALL}(b) c) {logs.CALL}\n(d) {logs.CALL}(e {logs.CALL}(f"
    tails = text.split(logs.CALL)[1:]
    expected = [matching_close(logs.CALL.join(tails[k:])) for k in range(len(tails))]
    assert expected == [f"a {logs.CALL}(b) c", "b", None, None, None]
    assert spark.createDataFrame([(text,)], "t string").select(logs.call_arguments(F.col("t")).alias("a")).first()["a"] == expected


def test_a_very_long_line(spark):
    calls = " ".join(call('{"find":[{"pattern":"p%d ((()))"}]}' % k) + " " + logs.CALL + "(" for k in range(12_000))
    line = event("(" * 80_000 + calls)
    assert len(line) > 1 << 20
    assert logs.keywords(events(spark, [line])).count() == 12_000


def test_repeated_members_and_odd_numbers(spark):
    kept, lost = call('{"find":[{"pattern":"kept"}]}'), call('{"find":[{"pattern":"lost"}]}')
    lines = [
        '{"a": %s, "b": NaN, "a": %s}' % (json.dumps(lost), json.dumps(kept)),
        '{"a": {"x": %s}, "n": [-Infinity, Infinity], "b": "NaN", "a": 1}' % json.dumps(lost),
        '{"x": -NaN, "y": %s}' % json.dumps(lost),
        '{"x": NaN, "y": "say \\"NaN\\" and Infinity"}',
        '{"p": {"k": "one"}, "q": {"k": "two"}, "k" : "three", "p": {"k": "four"}}',
        event(call('{"find":[{"pattern":"with NaN"}], "n": NaN}')),
    ]
    expected = [every_string(json.loads(line)) if "-NaN" not in line else [] for line in lines]
    found = logs.json_strings(events(spark, lines)).orderBy("at", "str_no").collect()
    assert [[r.text for r in found if r.at == k] for k in range(1, len(lines) + 1)] == expected
    assert mined(spark, lines) == [("pattern", 1, "kept"), ("pattern", 6, "with NaN")]


def test_keywords_in_first_seen_order(spark):
    q = '{"search_query":[{"q":"b \\"x\\" (1)"},{"q":"a"}],"find":[{"pattern":"p1"}]}'
    again = '{"find":[{"pattern":"a"},{"pattern":"p1"}],"search_query":[{"q":"a"},{"q":"c"}]}'
    lines = ["", event("short", call(q)), "{broken", event(call(again) + " then " + call('{"find":[{"pattern":"p0"}]}'))]
    assert mined(spark, lines) == [
        ("query", 2, 'b "x" (1)'),
        ("query", 2, "a"),
        ("query", 4, "c"),
        ("pattern", 2, "p1"),
        ("pattern", 4, "a"),
        ("pattern", 4, "p0"),
    ]


def test_odd_arguments_are_passed_over(spark):
    arguments = [
        "previousQuery",
        "[1, 2, 3, 4, 5, 6, 7]",
        '{"search_query": "not a list at all"}',
        '{"search_query": {"q": "an object"}, "find": null}',
        '{"search_query": ["text", 3, null, {"r": "x"}, {"q": ""}, {"q": "kept"}]}',
        '{"search_query": [{"q": "open}]',
        '{"search_query": [{"q": "kept too"}, {"q": 12}]} ',
        '"{\\"search_query\\": [{\\"q\\": \\"inside a string\\"}]}"',
    ]
    found = mined(spark, [event(call(a)) for a in arguments])
    assert found == [("query", 5, "kept"), ("query", 7, "kept too"), ("query", 7, "12")]


def test_a_parenthesis_inside_a_string_ends_the_argument(spark):
    assert mined(spark, [event(call('{"find":[{"pattern":"smile :)"}]}'))]) == []
    assert mined(spark, [event(call('{"find":[{"pattern":"call(x) ok"}]}'))]) == [("pattern", 1, "call(x) ok")]


def test_nested_call_names_and_escaped_names(spark):
    inner = '{"find":[{"pattern":"see tools.web__run({}) here"}]}'
    assert mined(spark, [event(call(inner))]) == [("pattern", 1, "see tools.web__run({}) here")]
    hidden = event(call('{"find":[{"pattern":"via escape"}]}')).replace("tools.", "\\u0074ools.")
    assert mined(spark, [hidden]) == [("pattern", 1, "via escape")]


def test_short_and_sealed_strings_are_skipped(spark):
    sealed = "gAAAAA" + call('{"find":[{"pattern":"secret"}]}')
    assert mined(spark, [event(sealed), event("tools.web__run({})")]) == []


def test_blocks_round_trip_through_files(spark, tmp_path):
    blocks = ["octet lattice threshold", '"quoted phrase" strut', "multi\nline", 'x "truss" XCT "threshold"', "(a) b"]
    patterns = ["Local", "local iterative", "octet lattice threshold"]
    argument = json.dumps({"search_query": [{"q": b} for b in blocks], "find": [{"pattern": p} for p in patterns]})
    found = logs.keywords(events(spark, [event(call(argument)), event(call(argument))]))
    logs.write_keyword_blocks(found, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text == "\n---\n".join(blocks + patterns) + "\n"
    counts = {r.kind: r.keywords for r in logs.keyword_counts(found).collect()}
    assert counts == {"query": 5, "pattern": 3}


def test_nothing_found_writes_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="no web search or find calls"):
        logs.write_keyword_blocks(logs.keywords(events(spark, [event("nothing here")])), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_a_batch_is_not_held_as_python_texts():
    # Lists of a whole batch's strings took more than twice the batch's own bytes.
    line = json.dumps({"a": "w" * 4000, "b": ["x" * 1000] * 4, "c": {"a": "y" * 900}})
    batch = pa.array([line] * 4000)
    tracemalloc.start()
    found = logs._listed(batch, logs._last_members)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 4
    assert len(found) == 4000 and found[3999].as_py() == ["w" * 4000, *["x" * 1000] * 4, "y" * 900]
    assert logs._listed(pa.array([None, "{", line]), logs._last_members).to_pylist()[:2] == [None, []]
