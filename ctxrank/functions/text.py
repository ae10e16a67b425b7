"""Text expressions: document text, completion parsing, chat lines.

All of them are built-in Spark expressions, so they run inside the JVM and
work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python treats as whitespace and as line ends. Java's
# Unicode \s lacks the separators 1C-1F, and \v lacks 1C-1E.
WHITESPACE = r"(?U:[\s\x1C-\x1F])"
WHITESPACE_CHARS = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)
LINE_END = r"\r\n|[\v\x1C\x1D\x1E]"
PIECE_END = r"[\v\x1C\x1D\x1E?]+"

# Markers in prompts and completions.
COMPLETION_END = "####"
QUESTIONS_HEADER = "Questions:"
EMPTY_PASSAGE = "Content:\n</passage>"
NO_CONTENT = "no content"
MIN_QUESTION_CHARS = 5

# Fixed value: the three shapes a raw JSON document may have.
RAW_DOCUMENT = "title STRING, text STRING, contents STRING, passage STRING"


def strip(text: Column) -> Column:
    """Remove whitespace, in the wide sense above, from both ends."""
    return F.trim(text, F.lit(WHITESPACE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    """Turn each run of whitespace into one space and trim the ends."""
    return F.trim(F.regexp_replace(text, rf"{WHITESPACE}+", " "))


def document_text(raw: Column) -> Column:
    """Text of a raw JSON document; a missing document has the text ``''``.

    A ``title`` wins over ``contents``, which wins over ``passage``. The JSON
    is parsed once: the parsed document is bound to a lambda's argument,
    because the optimizer would give each field used a parse of its own.
    """

    def content(doc: Column) -> Column:
        titled = F.concat(
            F.lit("Title: "), doc["title"], F.lit(" Content: "), F.coalesce(doc["text"], F.lit(""))
        )
        return F.coalesce(titled, doc["contents"], doc["passage"], F.lit(""))

    parsed = F.array(F.from_json(raw, RAW_DOCUMENT))
    return collapse_whitespace(F.transform(parsed, content)[0])


def split_lines(text: Column) -> Column:
    """Lines of a text; as in Python, a final line end opens no further line."""
    lines = F.split(text, LINE_END)
    kept = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
    return F.slice(lines, F.lit(1), kept)


def cut_completion(text: Column) -> Column:
    """A completion up to its first end marker."""
    return F.substring_index(text, COMPLETION_END, 1)


def clean_question(piece: Column, literal_strip: bool = False) -> Column:
    """Normalise one question: strip, unescape, lower-case, drop its numbering.

    By default leading two-character ``\n`` escapes and outer backslashes go;
    ``literal_strip`` drops any leading run of backslashes and of the letter n.
    """
    text = strip(piece)
    if literal_strip:
        text = F.ltrim(F.trim(text, F.lit("\\")), F.lit("\\n"))
    else:
        text = F.regexp_replace(F.rtrim(text, F.lit("\\")), r"\A(?:\\n|\\)+", "")
    return F.regexp_replace(F.lower(text), rf"\A(?:\p{{Nd}}+\.|-{WHITESPACE})", "")


def parse_questions(text: Column, literal_strip: bool = False) -> Column:
    """Array of the cleaned questions in a completion, in order.

    Line ends and question marks both separate pieces, so one split does for
    both; a null completion has no pieces.
    """
    pieces = F.split(text, PIECE_END)
    pieces = F.filter(pieces, lambda p: ~F.contains(p, F.lit(QUESTIONS_HEADER)))
    questions = F.transform(pieces, lambda p: clean_question(p, literal_strip))
    kept = F.filter(questions, lambda q: F.char_length(q) > MIN_QUESTION_CHARS)
    return F.coalesce(kept, F.array().cast("array<string>"))


def parse_passages(text: Column) -> Column:
    """Array of the stripped lines of a completion; blank lines are kept."""
    return F.transform(split_lines(text), strip)


def is_empty_passage(prompt: Column) -> Column:
    """True for a prompt whose document had a title but no content."""
    return F.contains(prompt, F.lit(EMPTY_PASSAGE))


def break_before_content(text: Column) -> Column:
    """Start a new line before each word ``Content:``."""
    return F.regexp_replace(text, r"(\bContent:)", "\n$1")


def chat_line(role: Column, content: Column, extras: Column | None = None) -> Column:
    """``role: content``; a non-empty map of extras follows on its own line."""
    line = F.concat(role, F.lit(": "), content)
    if extras is None:
        return line
    return F.when(F.size(extras) > 0, F.concat(line, F.lit("\n"), F.to_json(extras))).otherwise(line)


def terms(text: Column) -> Column:
    """Array of the lower-cased runs of letters in a text."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def word_windows(text: Column, size: int, step: int) -> Column:
    """Overlapping windows of words; a text of at most ``size`` words is one window.

    A null text has one null window, as a short text has one. The words are bound to a lambda's argument, so that the text is split once
    and not again for every window.
    """

    def windows(words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - size) / F.lit(step)), F.lit(0)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(words, i * step + 1, size), " "),
        )

    return F.transform(F.array(F.split(text, " ")), windows)[0]
