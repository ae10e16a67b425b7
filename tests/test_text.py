"""Golden values of the text expressions."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxrank.functions import text as X
from ctxrank.functions.prompts import TASKS, build_prompt, fill, question_task

LINE_ENDS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", chr(0x2028), chr(0x2029)]
HOSTILE = [*LINE_ENDS, " ", "\t", "\x1f", chr(0xA0), chr(0x3000), "\\", "\\n", "n", "?", "-", ".", "1", "12",
           "a", "Z", "Questions:", "٣"]


def apply(spark, expression, values, schema="value STRING"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {schema}")
    found = rows.select("i", expression(F.col("value")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in found]


def cleaned(piece: str, literal: bool) -> str:
    """The cleaning rules, written out for one text."""
    s = piece.strip()
    if literal:
        s = s.strip("\\").lstrip("\\n")
    else:
        s = s.rstrip("\\")
        while s.startswith("\\"):
            s = s[2:] if s.startswith("\\n") else s[1:]
    s = s.lower()
    digits = 0
    while digits < len(s) and s[digits].isdecimal():
        digits += 1
    if digits and s[digits : digits + 1] == ".":
        return s[digits + 1 :]
    if s.startswith("-") and s[1:2].isspace():
        return s[2:]
    return s


def questions_of(text: str | None, literal: bool) -> list[str]:
    pieces = [p for line in (text or "").splitlines() for p in line.split("?")]
    kept = [cleaned(p, literal) for p in pieces if "Questions:" not in p]
    return [q for q in kept if len(q) > 5]


GOLDEN = [
    ("1. What is X", [" what is x"]),
    ("- who asks", ["who asks"]),
    ("name the thing", ["name the thing"]),
    ("No Content", ["no content"]),
    ("no content", ["no content"]),
    ("2) foo bar", ["2) foo bar"]),
    ("12.", []),
    ("short", []),
    ("sixsix", ["sixsix"]),
    ("", []),
    (None, []),
    ("Questions:\n1. who?\n2. what now?", [" what now"]),
    ("one question? two question", ["one question", "two question"]),
    ("\\nescaped line\\", ["escaped line"]),
    ("my questions: are here", ["my questions: are here"]),
]


def test_parse_golden(spark):
    found = apply(spark, X.parse_questions, [g[0] for g in GOLDEN])
    assert found == [g[1] for g in GOLDEN]


def test_literal_strip_eats_a_leading_n(spark):
    texts = ["name the thing", "no content", "No Content"]
    found = apply(spark, lambda c: X.parse_questions(c, True), texts)
    assert found == [["ame the thing"], ["o content"], ["no content"]]


@pytest.mark.parametrize("end", LINE_ENDS)
def test_every_line_end_separates_questions(spark, end):
    text = f"first question{end}second question{end}"
    assert apply(spark, X.parse_questions, [text]) == [["first question", "second question"]]
    assert apply(spark, X.split_lines, [text]) == [text.splitlines()]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(HOSTILE), max_size=12).map("".join), min_size=40, max_size=40))
def test_text_rules_on_hostile_strings(spark, texts):
    for literal in (False, True):
        found = apply(spark, lambda c: X.parse_questions(c, literal), texts)
        assert found == [questions_of(t, literal) for t in texts]
    assert apply(spark, X.split_lines, texts) == [t.splitlines() for t in texts]
    assert apply(spark, X.parse_passages, texts) == [[x.strip() for x in t.splitlines()] for t in texts]
    assert apply(spark, X.collapse_whitespace, texts) == [" ".join(t.split()) for t in texts]
    assert apply(spark, X.strip, texts) == [t.strip() for t in texts]


def test_document_text(spark):
    documents = [
        {"title": "T", "text": "a\n b"},
        {"title": "T", "text": "x", "contents": "ignored"},
        {"contents": " c\t d ", "passage": "ignored"},
        {"passage": "p " + chr(0xA0) + " q"},
        {"title": "T", "text": ""},
        {"title": "", "text": "no title"},
    ]
    found = apply(spark, X.document_text, [json.dumps(d) for d in documents] + [None])
    assert found == [
        "Title: T Content: a b", "Title: T Content: x", "c d", "p q", "Title: T Content:",
        "Title: Content: no title", "",
    ]


def test_empty_passage_guard(spark):
    """A document with a title and no text makes the guard's prompt."""
    texts = ["Title: T Content:", "Title: T Content: words", ""]
    found = apply(spark, lambda c: X.is_empty_passage(build_prompt(c, "questions2")), texts)
    assert found == [True, False, False]


def test_completion_cut(spark):
    assert apply(spark, X.cut_completion, ["a####b####c", "abc", ""]) == ["a", "abc", ""]


def test_break_before_content(spark):
    texts = ["Title: a Content: b", "xContent: c", "Content: d Content: e"]
    assert apply(spark, X.break_before_content, texts) == [
        "Title: a \nContent: b", "xContent: c", "\nContent: d \nContent: e",
    ]


def test_chat_line(spark):
    rows = spark.sql("SELECT 'user' r, 'hi' c, map('k','v') e UNION ALL SELECT 'tool', 'x', map()")
    lines = rows.select(X.chat_line(F.col("r"), F.col("c"), F.col("e")).alias("l")).collect()
    assert sorted(r["l"] for r in lines) == ["tool: x", 'user: hi\n{"k":"v"}']


def test_prompts_keep_percent_and_braces(spark):
    text = "100% {of} {} %s"
    for task, template in TASKS.items():
        if task == "mr-tydi":
            continue
        before, after = template.split("{}")
        assert apply(spark, lambda c: build_prompt(c, task), [text]) == [before + text + after]
    assert apply(spark, lambda c: build_prompt(c, None), [text]) == [text]
    wrapped = apply(spark, lambda c: build_prompt(c, None, "<{}>"), [text])
    assert wrapped == [f"<{text}>"]
    in_german = apply(spark, lambda c: build_prompt(c, "mr-tydi", language="de"), [text])
    assert in_german[0].startswith("Please write a passage in de to answer")


def test_prompt_errors():
    with pytest.raises(ValueError):
        build_prompt(F.lit("x"), "no such task")
    with pytest.raises(ValueError):
        fill("{} and {}", F.lit("one"))


def test_topic_tasks():
    assert question_task("beir-v1.0.0-scidocs-test") == "questions2_scidocs"
    assert question_task("dl19-passage") == "questions2"


@pytest.mark.parametrize("words,expected", [(1, 1), (10, 1), (11, 2), (15, 2), (16, 3), (25, 4)])
def test_word_windows_cover_the_text(spark, words, expected):
    text = " ".join(str(i) for i in range(words))
    windows = apply(spark, lambda c: X.word_windows(c, 10, 5), [text])[0]
    assert len(windows) == expected
    assert {w for window in windows for w in window.split()} == set(text.split())
    assert all(len(w.split()) <= 10 for w in windows)


def test_documents_are_parsed_once(spark):
    raw = ['{"title": "a", "text": "b  c"}', '{"contents": "x"}', '{"passage": "y"}', "no json", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    parsed = df.select(X.document_text(F.col("raw")).alias("text"))
    assert [r.text for r in parsed.collect()] == ["Title: a Content: b c", "x", "y", "", ""]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_windows_of_empty_and_null_texts(spark):
    df = spark.createDataFrame([("a b c d e",), ("",), (None,)], "t string")
    found = [r[0] for r in df.select(X.word_windows(F.col("t"), 3, 2)).collect()]
    assert found == [["a b c", "c d e"], [""], [None]]
