"""Benchmark decontamination by suffix arrays of the training text.

Words are runs of ASCII letters and digits and of everything outside ASCII, A-Z in
lower case. Each shard of documents gets a suffix array over its words, sparse in
that only suffixes are kept whose first words occur in the benchmark, and compared up
to ``window`` words. Every suffix of every item is looked up in it by binary search;
the suffixes found on one diagonal join into the longest verbatim matches.

An item of fewer words than the window is one window by itself; one without words,
or null, matches nothing, like a null or empty document. Items with the same text all
count; an item id that is null is left out of the lists of ids. Documents are judged
row by row, so repeated rows and null ids are no special case. Other columns are not
read. The benchmark goes to the tasks in blocks of bounded size, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxrank.llm.arrays import ALPHANUMERIC, prefix_sums, sequence_hashes, slices, text_buffers, window_hashes, words

WINDOW = 13
# Words of a suffix that a first, cheap test looks at.
LEAD = 4
BLOCK_BYTES = 4 << 20


def hashed_words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and where each row's words begin (one more entry than rows)."""
    starts, ends, row_of = words(data, rows, ALPHANUMERIC)
    hashes = window_hashes(prefix_sums(data, fold_case=True), starts, ends)
    return hashes, np.searchsorted(row_of, np.arange(len(rows)), "left")


def _keys(ids: np.ndarray, at: np.ndarray, depth: int, stop: np.ndarray) -> np.ndarray:
    """The first ``depth`` word numbers of the suffixes at ``at`` as fixed strings that sort like them.

    Past ``stop``, the end of a suffix's document, stands 0, which no word has.
    """
    columns = at[:, None] + np.arange(depth)
    inside = columns < stop[:, None]
    numbers = np.where(inside, ids[np.minimum(columns, max(len(ids) - 1, 0))], 0)
    return np.ascontiguousarray(numbers.astype(">u4")).view(f"V{4 * depth}")[:, 0].view(f"S{4 * depth}")


@dataclass(frozen=True)
class Block:
    """Items ready for the search: the vocabulary, and their windows by length."""

    vocabulary: np.ndarray
    leads: dict[int, np.ndarray]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def prepare(texts: pa.Array, window: int = WINDOW) -> Block:
    """Windows of the items: for each length their sorted keys, and the item and place of each."""
    data, rows = text_buffers(texts)
    hashes, first = hashed_words(data[rows[0] : rows[-1]], rows - rows[0])
    vocabulary = np.unique(hashes)
    ids = np.searchsorted(vocabulary, hashes) + 1
    sizes = np.diff(first)
    leads: dict[int, list] = {}
    windows = {}
    for length in sorted({int(min(n, window)) for n in sizes if n}):
        items = np.flatnonzero((sizes == length) if length < window else (sizes >= window))
        places = [first[i] + np.arange(sizes[i] - length + 1) for i in items]
        at = np.concatenate(places)
        item = np.repeat(items, [len(p) for p in places])
        lead = min(length, LEAD)
        leads.setdefault(lead, []).append(sequence_hashes(hashes, lead)[at])
        keys = _keys(ids, at, length, np.full(len(at), len(ids)))
        windows[length] = (keys, item, at - first[item])
    return Block(vocabulary, {k: np.unique(np.concatenate(v)) for k, v in leads.items()}, windows)


def _known(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``wanted``: first by a table of their top bits."""
    bits = 20
    table = np.zeros(1 << bits, bool)
    table[(wanted >> np.uint64(64 - bits)).astype(np.int64)] = True
    found = table[(values >> np.uint64(64 - bits)).astype(np.int64)]
    at = np.flatnonzero(found)
    place = np.minimum(np.searchsorted(wanted, values[at]), len(wanted) - 1)
    found[at] = wanted[place] == values[at]
    return found


def search(block: Block, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word counts of a shard's documents, and (document, place, length, item, item place) of each window found."""
    hashes, first = hashed_words(data, rows)
    found: list[tuple[np.ndarray, ...]] = []
    kept = np.zeros(len(hashes), bool)
    for lead, wanted in block.leads.items():
        kept[: max(len(hashes) - lead + 1, 0)] |= _known(sequence_hashes(hashes, lead), wanted)
    at = np.flatnonzero(kept)
    if len(at):
        doc = np.searchsorted(first, at, "right") - 1
        stop = first[doc + 1]
        # Numbers only for words that a kept suffix reaches.
        near = np.unique(np.minimum(at[:, None] + np.arange(max(block.windows)), len(hashes) - 1))
        ids = np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(block.vocabulary, hashes[near]), len(block.vocabulary) - 1)
        ids[near] = np.where(block.vocabulary[place] == hashes[near], place + 1, 0)
        for length, (keys, item, item_at) in block.windows.items():
            own = _keys(ids, at, length, stop)
            # Numpy drops trailing zeros of such strings; words of the benchmark are never 0.
            order = np.argsort(own, kind="stable")
            suffixes = own[order]
            low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
            hits = high - low
            window_of = np.repeat(np.arange(len(keys)), hits)
            rank = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
            where = order[rank]
            found.append((doc[where], at[where] - first[doc[where]], np.full(len(where), length), item[window_of], item_at[window_of]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
    return np.diff(first), *columns


def longest(doc, place, length, item, item_at) -> tuple[np.ndarray, ...]:
    """Join windows that go on on the same diagonal of a document and an item."""
    if not len(doc):
        return doc, place, length, item, item_at
    order = np.lexsort((place, place - item_at, item, doc))
    doc, place, length, item, item_at = (c[order] for c in (doc, place, length, item, item_at))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (item_at[1:] != item_at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], place[first], place[last] + length[last] - place[first], item[first], item_at[first]


MATCH = T.ArrayType(
    T.StructType()
    .add("start", "long")
    .add("length", "long")
    .add("item", "string")
    .add("item_start", "long")
)


def verbatim_matches(docs: DataFrame, items: DataFrame, keep: str = "doc_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(keep, n_words, matches, items) of every document.

    ``matches`` are the longest verbatim matches: first word and length in the
    document, the item's id as text, first word in the item. Items of one text are
    searched once, and a match names the first of them; ``items`` names all.
    """
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    ids = F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids")
    named = items.select("item_id", "text").where("text is not null").groupBy("text").agg(ids)
    none = F.array().cast("array<string>").alias("items")
    rows = docs.select(F.col(f"`{keep}`").alias("kept"), "text", F.array().cast(MATCH).alias("matches"), none)
    for number in range(blocks):
        part = named.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number).toArrow()
        rows = _with_matches(rows, part, window).select(
            "kept", "text", "n_words", F.concat("matches", "found").alias("matches"), F.concat("items", "named").alias("items")
        )
    return rows.select(F.col("kept").alias(keep), "n_words", "matches", "items")


def _with_matches(rows: DataFrame, items: pa.Table, window: int) -> DataFrame:
    block = prepare(items.column("text").combine_chunks(), window)
    shared = rows.sparkSession.sparkContext.broadcast(
        (items.column("ids").to_pylist(), block.vocabulary, block.leads, block.windows)
    )
    kind = rows.select("kept", "text", "matches", "items").schema.add("n_words", "long").add("found", MATCH)
    kind = kind.add("named", T.ArrayType(T.StringType()))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
    entry = [pa.field(n, k) for n, k in zip(["start", "length", "item", "item_start"], kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *parts = shared.value
        block, named = Block(*parts), pa.array(ids, pa.list_(pa.string()))
        name = pa.array([i[0] if i else None for i in ids], pa.string())
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                n_words, *found = search(block, data, offsets)
                doc, start, length, item, item_start = longest(*found)
                values = pa.StructArray.from_arrays(
                    [pa.array(start, kinds[0]), pa.array(length, kinds[1]), name.take(pa.array(item, pa.int64())), pa.array(item_start, kinds[3])],
                    fields=entry,
                )
                ends = np.searchsorted(doc, np.arange(end - first + 1)).astype(np.int32)
                part = batch.slice(first, end - first)
                # Each text that matches a document names its items once.
                of, text = np.unique(np.stack([doc, item]), axis=1)
                every = named.take(pa.array(text, pa.int64()))
                stops = np.concatenate([[0], np.cumsum(every.value_lengths().to_numpy())])
                listed = pa.array(stops[np.searchsorted(of, np.arange(end - first + 1))].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(n_words.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), values),
                        pa.ListArray.from_arrays(listed, every.flatten()),
                    ],
                    names=kind.names,
                )

    return rows.select("kept", "text", "matches", "items").mapInArrow(run, kind)


def hit_counts(matches: DataFrame) -> DataFrame:
    """``matches`` with n_hit, the words covered by any match, and items sorted, each once."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("stop"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stop"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["stop"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(a["stop"], s["stop"]).alias("stop"),
    )
    return matches.withColumns(
        {
            "n_hit": F.aggregate(spans, start, step, lambda a: a["n"]),
            "items": F.array_sort(F.array_distinct("items")),
        }
    )


def contaminated(docs: DataFrame, items: DataFrame, keep: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(keep, n_words, n_hit, items, contaminated) per document: at least a twentieth of its words are hit."""
    found = verbatim_matches(docs, items, keep, block_bytes=block_bytes)
    judged = hit_counts(found)
    return judged.select(
        keep, "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def uncontaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "text")
    return contaminated(whole, items, "whole", block_bytes).where(~F.col("contaminated")).select("whole.*")
