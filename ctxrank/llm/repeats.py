"""Suffix-array dedup: every stretch of ``length`` bytes that stands more than once.

A suffix matters only up to its first ``length`` bytes, its window. Windows are
brought together without shuffling texts: each is filed under the smallest gram in
it, so equal windows share that gram and where it lies. One row stands for a run of
neighbouring windows under one gram, and only rows whose gram stands elsewhere too,
with other bytes around it, send those bytes on. There the windows are put in suffix
order (of fingerprints of their ``length`` bytes, which keeps equal ones together);
the previous and next smaller position within equal ones give the longest previous
factor: it reaches ``length`` for every window but the first of its kind. Grams of
many different surroundings are cut into chunks, whose fingerprints are exchanged.

Results are spans of first and of later copies, so that a caller can keep the first
or none. The order of copies is that of doc_id and place, a null id first. A null
text is empty; shorter texts have no windows; windows never cross documents. Repeated
rows are copies of each other and come out alike. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxrank.llm.arrays import mix, prefix_sums, slices, text_buffers, window_hashes
from ctxrank.llm.tables import joinable, split_by_filter
from ctxrank.session import stage

LENGTH = 400
GRAM = 200
NO_ID = -(1 << 63)
# Different surroundings of one gram that are compared at once, and bytes of them.
CHUNK = 512
BUCKET_BYTES = 2 << 20
# Sides of joins are broadcast up to so many bytes, filters of their keys up to these.
JOIN_BYTES = 4 << 20
FILTER_BYTES = 32 << 20

RUN = "gram long, around long, doc long, text_key long, start int, size int, first boolean, known boolean"
SPAN = "doc long, text_key long, start int, stop int, later boolean"


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each place the leftmost position of the smallest of ``width`` values from there on."""
    at = np.arange(len(values), dtype=np.int32)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        reach += step
    return at


def _segments(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the stretches of consecutive numbers with equal values of ``same``."""
    if not len(at):
        return np.zeros(0, int), np.zeros(0, int)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for values in same:
        new[1:] |= values[1:] != values[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at)) - 1


def copies(windows: np.ndarray, *position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window has an equal one, and whether one at a smaller position.

    In suffix order, ties by position, the previous smaller position of a window with
    the same bytes is its neighbour; only the first of its kind has none.
    """
    order = np.lexsort((*reversed(position), windows))
    same = windows[order][1:] == windows[order][:-1]
    later, often = np.zeros(len(windows), bool), np.zeros(len(windows), bool)
    later[order[1:]] = same
    often[order[1:]] = same
    often[order[:-1]] |= same
    return often, later


def runs_of(data: np.ndarray, rows: np.ndarray, docs: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """The ``RUN`` columns of a slice, without text_key: (row, gram, around, start, size, first, known).

    ``known`` rows are spans whose copies stand in the slice itself: later ones, and first
    ones again, as those still stand for their bytes elsewhere.
    """
    nothing = [np.zeros(0, np.int64)] * 7
    sizes = np.diff(rows)
    if not len(data) or sizes.max(initial=0) < length:
        return nothing
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = window_hashes(sums, at, at + gram)
    anchor = smallest(grams, length - gram + 1)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.arange(len(anchor))
    starts = starts[starts + length <= rows[1:][row_of[starts]]]
    if not len(starts):
        return nothing
    anchors = anchor[starts]
    first, last = _segments(starts, anchors)
    # Windows whose gram stands twice in the slice: keep one of each, note the others.
    key = grams[anchors[first]]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.repeat(count[back] > 1, last - first + 1)
    some = starts[twice]
    windows = window_hashes(sums, some, some + length)
    often, later = copies(windows, docs[row_of[some]], some)
    spans = []
    for flag, is_first in ((later, False), (often & ~later, True)):
        chosen = some[flag]
        a, b = _segments(chosen, row_of[chosen])
        spans.append((chosen[a], chosen[b] + length, np.full(len(a), is_first)))
    drop = np.zeros(len(starts), bool)
    drop[np.flatnonzero(twice)[later]] = True
    starts, anchors = starts[~drop], anchors[~drop]
    first, last = _segments(starts, anchors)
    low, high = starts[first], starts[last] + length
    around = mix(window_hashes(sums, low, high) ^ mix((anchors[first] - low + 1).astype(np.uint64)))
    begin = np.concatenate([low, *(s[0] for s in spans)])
    end = np.concatenate([high, *(s[1] for s in spans)])
    is_first = np.concatenate([np.zeros(len(low), bool), *(s[2] for s in spans)])
    known = np.arange(len(begin)) >= len(low)
    pad = np.zeros(len(begin) - len(low), np.uint64)
    row = row_of[begin]
    return [
        row,
        np.concatenate([grams[anchors[first]], pad]),
        np.concatenate([around, pad]),
        begin - rows[row],
        end - begin,
        is_first,
        known,
    ]


def _run_batches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, rows in slices(batch.column(2)):
                part = batch.slice(first, end - first)
                doc, text_key = part.column(0).to_numpy(), part.column(1).to_numpy()
                row, grams, around, start, size, is_first, known = runs_of(data, rows, doc, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams.astype(np.uint64).view(np.int64)),
                        pa.array(around.astype(np.uint64).view(np.int64)),
                        pa.array(doc[row]),
                        pa.array(text_key[row]),
                        pa.array(start.astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(is_first.astype(bool)),
                        pa.array(known.astype(bool)),
                    ],
                    names=["gram", "around", "doc", "text_key", "start", "size", "first", "known"],
                )

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches wanted from each document; wanted is a list of structs."""
    for batch in batches:
        for text, wanted in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
            text = text.as_py() or b""
            entries = wanted.values
            start, size = entries.field("start").to_pylist(), entries.field("size").to_pylist()
            cut = pa.array([text[s : s + n] for s, n in zip(start, size)], pa.binary())
            names = [f.name for f in entries.type]
            yield pa.RecordBatch.from_arrays([*entries.flatten(), cut], names=[*names, "content"])


def _windows(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of each row's content: the row, the place in its document, the fingerprint."""
    data, ends = text_buffers(rows.column("content").combine_chunks())
    data, ends = data[ends[0] : ends[-1]], ends - ends[0]
    sums = prefix_sums(data)
    counts = np.maximum(np.diff(ends) - length + 1, 0)
    row = np.repeat(np.arange(rows.num_rows), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = ends[:-1][row] + inside
    return row, rows.column("start").to_numpy()[row] + inside, window_hashes(sums, at, at + length)


COMPARED = SPAN + ", gram long, chunk int, part int, prints binary"


def _spans(rows: pa.Table, row: np.ndarray, place: np.ndarray, flags: np.ndarray, later: bool, length: int) -> dict:
    chosen = np.flatnonzero(flags)
    a, b = _segments(place[chosen], row[chosen])
    own = row[chosen[a]]
    return {
        "doc": rows.column("doc").to_numpy()[own],
        "text_key": rows.column("text_key").to_numpy()[own],
        "start": place[chosen[a]],
        "stop": place[chosen[b]] + length,
        "later": np.full(len(a), later),
    }


def _table(parts: list[dict], schema: pa.Schema) -> pa.Table:
    tables = []
    for part in parts:
        n = len(next(iter(part.values())))
        columns = [pa.array(part[f.name], f.type) if f.name in part else pa.nulls(n, f.type) for f in schema]
        tables.append(pa.Table.from_arrays(columns, schema=schema))
    return pa.concat_tables(tables)


_compared = pa.schema(
    [("doc", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("later", pa.bool_()),
     ("gram", pa.int64()), ("chunk", pa.int32()), ("part", pa.int32()), ("prints", pa.binary())]
)
_PRINT = np.dtype([("window", "<u8"), ("doc", "<i8"), ("start", "<i4")])


def _distinct(rows: pa.Table) -> pa.Table:
    """One row per gram and surroundings: a repeated document sends its bytes as often as it stands."""
    keys = np.stack([rows.column("gram").to_numpy(), rows.column("around").to_numpy()], 1)
    _, first = np.unique(keys, axis=0, return_index=True)
    return rows.take(pa.array(first))


def _compare(length: int):
    def run(rows: pa.Table) -> pa.Table:
        """Copies within a bucket; the fingerprints of grams of several chunks go on."""
        rows = _distinct(rows)
        row, place, windows = _windows(rows, length)
        doc = rows.column("doc").to_numpy()[row]
        often, later = copies(windows, doc, place)
        often |= rows.column("n").to_numpy()[row] > 1
        found = [
            _spans(rows, row, place, later, True, length),
            _spans(rows, row, place, often & ~later, False, length),
        ]
        chunks, gram, chunk = (rows.column(c).to_numpy() for c in ("chunks", "gram", "chunk"))
        sent = {"gram": [], "chunk": [], "part": [], "prints": []}
        for g, c in sorted({(g, c) for g, c, n in zip(gram.tolist(), chunk.tolist(), chunks) if n > 1}):
            mine = (gram == g) & (chunk == c)
            own = np.flatnonzero(mine[row] & ~later)
            prints = np.zeros(len(own), _PRINT)
            prints["window"], prints["doc"], prints["start"] = windows[own], doc[own], place[own]
            parts = int(chunks[mine][0])
            part_of = (prints["window"] % np.uint64(parts)).astype(int)
            for part in np.unique(part_of).tolist():
                sent["gram"].append(g)
                sent["chunk"].append(c)
                sent["part"].append(part)
                sent["prints"].append(prints[part_of == part].tobytes())
        return _table([*found, sent], _compared)

    return run


def _exchange(rows: pa.Table) -> pa.Table:
    """For each chunk the fingerprints that another chunk has too, and whether at a smaller position."""
    prints = [np.frombuffer(p.as_py(), _PRINT) for p in rows.column("prints")]
    chunk = np.repeat(rows.column("chunk").to_numpy(), [len(p) for p in prints])
    merged = np.concatenate(prints)
    often, later = copies(merged["window"], merged["doc"], merged["start"], chunk)
    found: dict[str, list] = {"gram": [], "chunk": [], "later": [], "prints": []}
    for c in np.unique(chunk).tolist():
        for flag, is_later in ((later, True), (often & ~later, False)):
            own = np.sort(merged["window"][(chunk == c) & flag])
            if len(own):
                found["gram"].append(rows.column("gram")[0].as_py())
                found["chunk"].append(c)
                found["later"].append(is_later)
                found["prints"].append(own.tobytes())
    return _table([found], _compared)


def _settle(length: int):
    def run(rows: pa.Table, shared: pa.Table) -> pa.Table:
        if not rows.num_rows or not shared.num_rows:
            return _compared.empty_table()
        rows = _distinct(rows)
        row, place, windows = _windows(rows, length)
        found = []
        for is_later in (True, False):
            lists = [np.frombuffer(p.as_py(), "<u8") for p, f in zip(shared.column("prints"), shared.column("later")) if f.as_py() == is_later]
            flags = np.isin(windows, np.concatenate(lists)) if lists else np.zeros(len(windows), bool)
            found.append(_spans(rows, row, place, flags, is_later, length))
        return _table(found, _compared)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_key"), "text"
    )


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, join_bytes: int = JOIN_BYTES
) -> DataFrame:
    """(doc, text_key, start, stop, later): bytes covered by windows with a copy, by first and later copies.

    Spans of a document may overlap; a window that is in a later span and in a first one is later.
    """
    rows = _rows(docs)
    runs = stage(rows.mapInArrow(_run_batches(length, gram), RUN))
    key = ["gram", "around"]
    place = F.struct("doc", "start", "text_key", "size")
    kinds = runs.where("not known").groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("least"))
    kinds = stage(kinds)
    shared = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    live = stage(kinds.join(shared.select("gram", "kinds"), "gram"))

    # Later copies of whole runs, and first copies of runs whose gram has no other surroundings.
    whole = runs.where("not known").join(live.where("n > 1").select(*key, "least", "kinds"), key)
    is_least = (F.col("least.doc") == F.col("doc")) & (F.col("least.start") == F.col("start")) & (F.col("least.text_key") == F.col("text_key"))
    span = ["doc", "text_key", "start", (F.col("start") + F.col("size")).alias("stop")]
    spans = [
        runs.where("known").select(*span, (~F.col("first")).alias("later")),
        whole.where(~is_least | (F.col("kinds") == 1)).select(*span, (~is_least).alias("later")),
    ]

    wanted = live.where("kinds > 1").select(
        *key, "n", F.ceil(F.col("kinds") / chunk).cast("int").alias("chunks"), "least.doc", "least.text_key", "least.start", "least.size"
    )
    wanted = wanted.withColumn("chunk", F.pmod("around", F.col("chunks").cast("long")).cast("int"))
    total = wanted.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("gram", "chunk"), F.lit(buckets)))
    entries = F.collect_list(F.struct(*wanted.columns)).alias("wanted")
    listed = stage(wanted.groupBy("doc", "text_key").agg(entries))
    few, _ = split_by_filter(rows, listed, ["doc", "text_key"], FILTER_BYTES if join_bytes else 0)
    found = few.join(joinable(listed, join_bytes), ["doc", "text_key"]).select("text", "wanted")
    schema = T.StructType(list(wanted.schema)).add("content", "binary")
    contents = stage(found.mapInArrow(_contents, schema))

    compared = stage(contents.groupBy("bucket").applyInArrow(_compare(length), COMPARED))
    spans.append(compared.where("prints is null").select("doc", "text_key", "start", "stop", "later"))
    exchanged = compared.where("prints is not null").groupBy("gram", "part").applyInArrow(_exchange, COMPARED)
    several = contents.where("chunks > 1").groupBy("gram", "chunk")
    settled = several.cogroup(exchanged.groupBy("gram", "chunk")).applyInArrow(_settle(length), COMPARED)
    spans.append(settled.select("doc", "text_key", "start", "stop", "later"))
    whole_spans = spans[0]
    for other in spans[1:]:
        whole_spans = whole_spans.unionByName(other)
    return whole_spans


def _cut(keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                text = text.as_py() or b""
                cover = np.zeros(len(text) + 1, np.int32)
                for s in found or ():
                    if s["later"] or not keep_first:
                        cover[s["start"]] += 1
                        cover[s["stop"]] -= 1
                inside = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                left = np.frombuffer(text, np.uint8)[~inside].tobytes()
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                spans.append([{"start": a, "stop": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256", "kept"]
            )

    return run


def without_repeats(
    docs: DataFrame, spans: DataFrame, keep_first: bool = True, join_bytes: int = JOIN_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept_sha256, kept) per row, with the spans cut out."""
    listed = spans.groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "stop", "later")).alias("spans"))
    listed = stage(listed)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    schema = docs.select("doc_id").schema
    for name, kind in zip(["n_bytes", "n_removed"], ["long", "long"]):
        schema = schema.add(name, kind)
    removed = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
    schema = schema.add("removed", removed).add("kept_sha256", "string").add("kept", "binary")
    few, others = split_by_filter(rows, listed, ["doc", "text_key"], FILTER_BYTES if join_bytes else 0)
    joined = few.join(joinable(listed, join_bytes), ["doc", "text_key"], "left").select("doc_id", "text", "spans")
    if others is not None:
        joined = joined.unionByName(others.select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans")))
    return joined.mapInArrow(_cut(keep_first), schema)
