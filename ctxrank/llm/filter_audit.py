"""Filter interaction audit: what each filter removes under every order of the filters.

A document's failures of the five filters decide which of their 32 subsets it survives;
bit s of its 32-bit truth-table word says whether it survives subset s. The words are
added bit by bit with carry-save adders, so that a part's survivors of all subsets cost
a few logical operations a word. From these counts follow, for any order, what each step
keeps and removes, and the Shapley value of each filter.

Words of a text are runs of anything but the white space 0x20 and 0x09-0x0D. A null text
is empty, a null source the part ''. A copy is a row whose text also stands in a row with a
smaller doc_id: rows of one id and text are no copies of each other, and a null id is
neither smaller nor larger than any. A document's label is 1 if any row of the labels says
so, and 0 without one. Texts are compared by SHA-256, words of one text by 64-bit hashes.
An empty table has no parts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxrank.llm.arrays import NOT_SPACE, byte_table, mix, prefix_sums, slices, window_hashes, words
from ctxrank.llm.statistics import CHARACTER
from ctxrank.session import stage

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
# Whose survivors are counted: all documents, those of label quality and of label toxic.
GROUPS = 3
# A task adds up its words as soon as it holds so many.
BUFFER_WORDS = 1 << 18

_UPPER = byte_table("AZ")
_SYMBOL = byte_table("#&**||")


def _per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[rows[1:]] - sums[rows[:-1]]


def _distinct(keys: np.ndarray, row_of: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each row has; ``row_of`` rises."""
    order = np.lexsort((keys, row_of))
    keys, row_of = keys[order], row_of[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (row_of[1:] != row_of[:-1])
    return np.bincount(row_of[fresh], minlength=n)


def text_failures(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 of each text: fails A (short), B (repeats words), C (capitals), D (symbols)."""
    n = len(rows) - 1
    starts, ends, row_of = words(data, rows, NOT_SPACE)
    n_words = np.bincount(row_of, minlength=n)
    distinct = _distinct(window_hashes(prefix_sums(data), starts, ends), row_of, n)
    fails = [
        n_words < 200,
        100 * distinct < 50 * n_words,
        100 * _per_row(_UPPER[data], rows) > 2 * _per_row(CHARACTER[data], rows),
        _per_row(_SYMBOL[data], rows) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails) of every document; bit i of ``fails`` is filter i of ``FILTERS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, rows in slices(batch.column(3)):
                kept = [batch.column(i).slice(first, end - first) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text_failures(data, rows))], names=names)

    text = F.coalesce("text", F.lit(""))
    source = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), "text"
    )
    kind = source.drop("text").schema.add("fails", "integer")
    names = kind.names
    texts = stage(source.mapInArrow(run, kind))
    # Joined by the document itself, a text with many copies is no hot key.
    firsts = texts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return texts.join(firsts, ["digest", "doc_id"], "left").select(
        "doc_id", "part", (F.col("fails") + F.when(copy, 1 << 4).otherwise(0)).alias("fails")
    )


def truth_tables() -> np.ndarray:
    """The word of each combination of failures: bit s is set if none of them lies in subset s."""
    subsets = np.arange(SUBSETS)
    survives = (subsets[:, None] & subsets[None, :]) == 0
    return (survives << subsets).sum(1).astype(np.uint32)


def positional_popcount(words_: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set, by carry-save adders.

    A full adder takes three words of one weight to a sum of that weight and a carry of
    twice the weight, for all bits at once; at most two words of each weight are left.
    """
    totals, weight, layer = np.zeros(32, np.int64), 1, words_
    while len(layer):
        carries = []
        while len(layer) > 2:
            third = len(layer) // 3
            a, b, c = layer[:third], layer[third : 2 * third], layer[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            layer = np.concatenate([half ^ c, layer[3 * third :]])
        for word in layer:
            totals += weight * ((int(word) >> np.arange(32)) & 1)
        layer = np.concatenate(carries) if carries else layer[:0]
        weight *= 2
    return totals


def survivors(flagged: DataFrame) -> DataFrame:
    """(part, survivors, good, toxic) from rows of (part, fails, is_good, is_toxic).

    Each is an array by subset: how many of the part's documents, of its good and of its
    toxic ones survive all filters of that subset. A part of any size is added up in the
    tasks that hold its rows, so that only counts are shuffled.
    """
    table = truth_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        n = 0

        def added_up() -> pa.RecordBatch:
            counts = []
            for rows in held.values():
                found = np.concatenate(rows)
                word, group = found & np.uint64(0xFFFFFFFF), found >> np.uint64(32)
                for mask in range(GROUPS):
                    chosen = word if mask == 0 else word[(group >> np.uint64(mask - 1)) & np.uint64(1) == 1]
                    counts.append(positional_popcount(chosen.astype(np.uint32)))
            values = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))
            wide = GROUPS * SUBSETS
            lists = pa.ListArray.from_arrays(np.arange(0, wide * len(held) + 1, wide, dtype=np.int32), values)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), lists], names=["part", "counts"])

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            codes = parts.indices.to_numpy(zero_copy_only=False)
            label = sum(batch.column(2 + i).to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(i) for i in range(2))
            rows = table[batch.column(1).to_numpy()].astype(np.uint64) | (label << np.uint64(32))
            order = np.argsort(codes, kind="stable")
            for part, mine in zip(
                parts.dictionary.to_pylist(),
                np.split(rows[order], np.searchsorted(codes[order], np.arange(1, len(parts.dictionary)))),
            ):
                held.setdefault(part, []).append(mine)
            n += len(rows)
            if n >= BUFFER_WORDS:
                yield added_up()
                held.clear()
                n = 0
        yield added_up()

    flagged = flagged.select("part", "fails", "is_good", "is_toxic")
    counts = flagged.mapInArrow(run, "part string, counts array<long>")
    sums = counts.groupBy("part").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(GROUPS * SUBSETS)]).alias("n"))
    return sums.select(
        "part", *[F.slice("n", 1 + i * SUBSETS, SUBSETS).alias(c) for i, c in enumerate(("survivors", "good", "toxic"))]
    )


def _shapley(filter_: int) -> Column:
    """What a filter removes, summed over all orders: each subset before it stands in |S|! (n-1-|S|)! of them."""
    n, bit = len(FILTERS), 1 << filter_
    total = F.lit(0).cast("long")
    for s in range(SUBSETS):
        if not s & bit:
            size = s.bit_count()
            times = factorial(size) * factorial(n - 1 - size)
            total = total + F.lit(times) * (F.col("survivors")[s] - F.col("survivors")[s | bit])
    return total


def orders(counted: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the ``survivors`` of each part."""
    grid, whole = [], SUBSETS - 1
    for order in permutations(range(len(FILTERS))):
        before, name = 0, "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            grid.append((len(grid), name, step, i, before, before | 1 << i, 1 << i, whole & ~(1 << i)))
            before |= 1 << i
    names = "cell int, filter_order string, step int, nth int, before int, after int, single int, others int"
    cells = counted.sparkSession.createDataFrame(grid, names)
    left = lambda column, subset: F.element_at(column, F.col(subset) + 1)
    lost = lambda column: left(column, "before") - left(column, "after")
    return (
        counted.withColumn("shapley", F.array(*[_shapley(i) for i in range(len(FILTERS))]))
        .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
        .join(F.broadcast(cells), "cell")
        .select(
            "part",
            "filter_order",
            "step",
            left("survivors", "after").alias("kept"),
            lost("survivors").alias("removed"),
            (F.col("survivors")[0] - left("survivors", "single") - lost("survivors")).alias("redundant"),
            (left("survivors", "others") - F.col("survivors")[whole]).alias("unique_fails"),
            lost("good").alias("good_lost"),
            lost("toxic").alias("toxic_lost"),
            F.element_at("shapley", F.col("nth") + 1).alias("shapley"),
        )
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of ``orders`` over the five filters and all documents."""
    is_one = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)))
    known = labels.groupBy("doc_id").agg(is_one("quality").alias("is_good"), is_one("toxic").alias("is_toxic"))
    flagged = judged(docs).join(known, "doc_id", "left").fillna(False, ["is_good", "is_toxic"])
    return orders(survivors(flagged))
