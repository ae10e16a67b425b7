"""Line dedup: a line found in many documents stays only in the one with the largest id.

Hashes of lines are range-partitioned with the document as second key, so a line
of a third of all documents is spread over as many partitions as its rows fill.
Each partition streams its sorted rows; only the first and the last line of a
partition, which may go on in its neighbours, are settled by a second, small
aggregation. What comes back is a compressed keep bitmap per document.

Null or empty text is one empty line. Rows with the same id are one document when
documents are counted, and each keeps its own lines; a null id is one document
below all others. Repeated rows get the same bitmap. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxrank.llm.tables import joinable, with_text
from ctxrank.session import stage

SPACE = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)
JOIN_BYTES = 32 << 20


def _entry_batches(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, lines, keys, positions = [], [], [], [], []
            ids, sums = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, own, text in zip(ids, sums, batch.column(2).cast(pa.binary())):
                found: dict[bytes, list[int]] = {}
                parts = (text.as_py() or b"").split(b"\n")
                for at, line in enumerate(parts):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(SPACE).lower()
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                docs += [doc] * len(found)
                texts += [own] * len(found)
                lines += [len(parts)] * len(found)
                keys += found
                positions += [np.array(p, "<u4").tobytes() for p in found.values()]
                if len(docs) > 20_000:
                    yield _entries(docs, texts, lines, keys, positions)
                    docs, texts, lines, keys, positions = [], [], [], [], []
            yield _entries(docs, texts, lines, keys, positions)

    return run


def _entries(docs, texts, lines, keys, positions) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.ascontiguousarray(halves[:, 0])),
            pa.array(np.ascontiguousarray(halves[:, 1])),
            pa.array(docs, pa.int64()),
            pa.array(texts, pa.int64()),
            pa.array(lines, pa.int32()),
            pa.array(positions, pa.binary()),
        ],
        names=["h1", "h2", "doc", "text_key", "n_lines", "positions"],
    )


ENTRY = "h1 long, h2 long, doc long, text_key long, n_lines int, positions binary"


def line_entries(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per document and distinct long line: the line's 128-bit hash and where it stands."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("text_key"),
        "text",
    )
    return rows.mapInArrow(_entry_batches(min_chars), ENTRY)


def _stream(min_docs: int):
    """Settle the lines of one sorted partition; the rows of its first and last line stay open.

    Rows come by hash and falling document, so a line's first row names the document
    that keeps it. Held are a batch and the rows of the line that goes on in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        first_key = None

        def chosen(rows: pa.Table, is_open: np.ndarray, drop: np.ndarray) -> list[pa.RecordBatch]:
            some = np.flatnonzero(is_open | drop)
            out = rows.take(pa.array(some)).append_column("open", pa.array(is_open[some]))
            return out.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            h1, h2, doc = (rows.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            first_key = first_key or (h1[0], h2[0])
            is_open = (h1 == first_key[0]) & (h2 == first_key[1])
            if is_open.all():
                held = None
                yield from chosen(rows, is_open, ~is_open)
                continue
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(new)
            last = int(starts[-1])
            held = rows.slice(last)
            if not last:
                continue
            run_of = np.cumsum(new[:last]) - 1
            change = new[:last].copy()
            change[1:] |= doc[1:last] != doc[: last - 1]
            n_docs = np.bincount(run_of, change)
            top = doc[starts[:-1]][run_of]
            drop = (n_docs[run_of] >= min_docs) & (doc[:last] != top) & ~is_open[:last]
            yield from chosen(rows.slice(0, last), is_open[:last], drop)
        if held is not None:
            every = np.ones(held.num_rows, bool)
            yield from chosen(held, every, ~every)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, lists in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, bool)
            for positions in lists:
                keep[np.frombuffer(positions, "<u4")] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(maps, pa.binary())], names=["doc", "text_key", "n_lines", "keep"]
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, text_key, n_lines, keep) of every document that loses a line.

    ``keep`` is a zlib-compressed bit per line, 1 where the line stays. Documents that
    lose nothing have no row.
    """
    entries = stage(line_entries(docs, min_chars))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    sorted_rows = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(sorted_rows.mapInArrow(_stream(min_docs), ENTRY + ", open boolean"))
    edges = found.where("open")
    # Two lines a partition at most.
    settled = (
        edges.groupBy("h1", "h2")
        .agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("top"))
        .where(F.col("n_docs") >= min_docs)
    )
    late = edges.join(F.broadcast(settled), ["h1", "h2"]).where("doc <> top")
    columns = ["doc", "text_key", "n_lines", "positions"]
    drops = found.where("not open").select(*columns).unionByName(late.select(*columns))
    by_document = drops.groupBy("doc", "text_key").agg(
        F.max("n_lines").alias("n_lines"), F.collect_list("positions").alias("positions")
    )
    return by_document.mapInArrow(_bitmaps, "doc long, text_key long, n_lines int, keep binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines a bitmap drops; the last two columns are text and keep."""
    for batch in batches:
        texts, lines, dropped = [], [], []
        rest = batch.num_columns - 2
        for text, packed in zip(batch.column(rest).cast(pa.binary()), batch.column(rest + 1)):
            text, packed = text.as_py(), packed.as_py()
            if packed is None:
                texts.append(text)
                lines.append((text or b"").count(b"\n") + 1)
                dropped.append(0)
                continue
            parts = (text or b"").split(b"\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[: len(parts)]
            texts.append(b"\n".join([p for p, k in zip(parts, keep) if k]))
            lines.append(len(parts))
            dropped.append(len(parts) - int(keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:rest], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            names=[*batch.schema.names[:rest], "kept_text", "n_lines", "n_dropped"],
        )


def without_lines(docs: DataFrame, bitmaps: DataFrame, join_bytes: int = JOIN_BYTES) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped) for every row of ``docs``; ``row`` holds its columns."""
    side = joinable(stage(bitmaps.select("doc", "text_key", "keep")), join_bytes)
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("text_key"),
        "text",
    )
    joined = rows.join(side, ["doc", "text_key"], "left").select("row", "text", "keep")
    kind = T.StructType(
        [
            joined.schema["row"],
            T.StructField("kept_text", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )
    return joined.mapInArrow(_applied, kind)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, join_bytes: int = JOIN_BYTES) -> DataFrame:
    """``docs`` without repeated lines: the same rows and columns, with shorter texts."""
    kept = without_lines(docs, keep_bitmaps(docs, min_chars, min_docs), join_bytes)
    others = [F.col("row")[c].alias(c) if c != "text" else F.col("kept_text").alias("text") for c in docs.columns]
    return with_text(kept.select(*others), F.col("text"))
