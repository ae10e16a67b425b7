"""Counts of a text that quality rules look at, taken from its bytes.

Words are runs of anything but the white space 0x20 and 0x09-0x0D. A null text has
no words and one empty line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ctxrank.llm.arrays import (
    NOT_SPACE,
    byte_table,
    mix,
    prefix_sums,
    sequence_hashes,
    slices,
    window_hashes,
    words,
)

SYMBOLS = byte_table("##**$$%%&&||<>") & ~byte_table("==")
UPPER, DIGIT, MARK = byte_table("AZ"), byte_table("09"), byte_table("!!??")
CHARACTER = ~byte_table("\x80\xbf")

COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_chars_all n_lines n_upper n_digits n_marks"
    " n_distinct_words n_same_as_last"
).split()


def _per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[rows[1:]] - sums[rows[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key stands more than once, and whether it stood before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    often[order[1:]] |= same
    often[order[:-1]] |= same
    return often, later


def counts(data: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The ``COUNTS`` of each row."""
    n = len(rows) - 1
    sums = prefix_sums(data)
    starts, ends, row_of = words(data, rows)
    hashes = window_hashes(sums, starts, ends)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    per_row = lambda of: np.bincount(of, minlength=n)
    inside = NOT_SPACE[data]

    triples = sequence_hashes(hashes, 3)
    whole = row_of[: len(triples)] == row_of[2:] if len(triples) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    often, _ = _repeats(mix(triples[at] ^ salt[row_of[at]]))
    covered = np.zeros(len(starts) + 2, bool)
    for j in range(3):
        covered[at[often] + j] = True

    _, word_before = _repeats(mix(hashes ^ salt[row_of]))
    same_as_last = np.zeros(len(starts), bool)
    same_as_last[1:] = (hashes[1:] == hashes[:-1]) & (row_of[1:] == row_of[:-1])

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([rows[:-1], breaks + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([rows[1:], breaks]), kind="stable")
    line_row = np.repeat(np.arange(n), _per_row(data == 10, rows) + 1)
    inside_sums = np.concatenate([[0], np.cumsum(inside)])
    filled = inside_sums[line_ends] > inside_sums[line_starts]
    _, line_before = _repeats(mix(window_hashes(sums, line_starts, line_ends)[filled] ^ salt[line_row[filled]]))

    return [
        per_row(row_of),
        _per_row(inside & CHARACTER[data], rows),
        _per_row(SYMBOLS[data], rows),
        per_row(line_row[filled][line_before]),
        per_row(row_of[covered[: len(starts)]]),
        _per_row(CHARACTER[data], rows),
        per_row(line_row),
        _per_row(UPPER[data], rows),
        _per_row(DIGIT[data], rows),
        _per_row(MARK[data], rows),
        per_row(row_of[~word_before]),
        per_row(row_of[same_as_last]),
    ]


def text_counts(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """The ``COUNTS`` of every text next to the column ``keep`` of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, rows in slices(batch.column(1)):
                columns = [pa.array(c.astype(np.int64)) for c in counts(data, rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *columns], names=[keep, *COUNTS]
                )

    schema = docs.select(keep).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    return docs.select(keep, "text").mapInArrow(run, schema)
