"""Packing: token sequences of bounded length, filled online.

Each partition keeps a fixed number of open windows. A document's tokens are cut
into whole windows, which leave at once, and a rest; the rest goes into the open
window with the least room that still takes it, and when none does, the fullest
window leaves. What is still open at the end of the partitions is merged: the open
windows of ``MERGE_PARTITIONS`` partitions are joined end to end and cut into whole
windows, and the last rest into powers of two, which need no padding.

Tokens come from a public tokenizer file. A text's ids are those of the tokenizer
with one end id behind them, so a null or empty text is that id alone. Repeated rows
are packed as often as they stand; a null id is passed on. Other columns are not
read. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrank.session import stage

WINDOW = 4096
OPEN_WINDOWS = 64
MERGE_PARTITIONS = 16
CACHED_WORDS = 400_000



# Words that the fast path splits: printable ASCII and Latin letters, which need no
# Unicode normalisation; others go through the tokenizer itself.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
END = "\x00"


def byte_pair_ranks(model: dict) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE with word ends as bytes, ``END`` standing for the end."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    suffix = model["end_of_word_suffix"]
    ranks = {}
    for token, number in model["vocab"].items():
        if token.startswith("<|"):
            continue
        core = token.removesuffix(suffix)
        ranks[bytes(byte_of[c] for c in core) + (END.encode() if core != token else b"")] = number
    return ranks


def word_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizer of ``path`` gives them, word by word from a bounded cache.

    For lower-casing BPE tokenizers with word ends that drop white space: there no
    token crosses a space or a line break, so a text's ids are those of its words in
    turn. Plain words are merged by the vocabulary directly, which is ten times as
    fast as a call of the tokenizer; all others by the tokenizer.
    """
    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        ranks = byte_pair_ranks(json.load(file)["model"])
    merges = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
    is_end = np.zeros(max(ranks.values()) + 1, bool)
    is_end[[number for token, number in ranks.items() if token.endswith(END.encode())]] = True
    known: dict[str, bytes] = {}

    def learn(new: list[str]) -> None:
        plain = [w for w in new if PLAIN.fullmatch(w) and "<|" not in w]
        pieces = [PIECE.findall(w.lower()) for w in plain]
        made = np.array(merges.encode_ordinary("".join([END.join(p) + END for p in pieces])), "<u4")
        ends = np.concatenate([[0], np.flatnonzero(is_end[made]) + 1])
        cuts = (4 * ends[np.cumsum([0, *map(len, pieces)])]).tolist()
        raw = made.tobytes()
        known.update(zip(plain, [raw[low:high] for low, high in zip(cuts, cuts[1:])]))
        if len(plain) < len(new):
            others = [w for w in new if w not in known]
            made_by_tokenizer = tokenizer.encode_batch(others, add_special_tokens=False)
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(others, made_by_tokenizer))

    def encode(text: str) -> np.ndarray:
        if text.isascii():
            text = text.lower()
        parts = text.replace("\n", " ").split(" ")
        new = list(set(parts).difference(known))
        if new:
            if len(known) + len(new) > CACHED_WORDS:
                known.clear()
                new = list(set(parts))
            learn(new)
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4")

    return encode


class Windows:
    """The open windows of one partition, by how much room they have."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.by_room: list[tuple[int, int]] = []
        self.content: dict[int, list] = {}
        self.made = 0

    def place(self, piece: tuple, length: int) -> list | None:
        """Put a piece into the best window; the pieces of the window that had to leave, if one had."""
        left = None
        at = bisect_left(self.by_room, (length, -1))
        if at == len(self.by_room):
            if len(self.by_room) == self.limit:
                left = self.content.pop(self.by_room.pop(0)[1])
            room, number = self.window, self.made
            self.made += 1
            self.content[number] = []
        else:
            room, number = self.by_room.pop(at)
        self.content[number].append(piece)
        if room > length:
            insort(self.by_room, (room - length, number))
            return left
        full = self.content.pop(number)
        return full if left is None else left + [None] + full

    def rest(self) -> Iterator[list]:
        yield from self.content.values()


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    merge_partitions: int = MERGE_PARTITIONS,
) -> DataFrame:
    """A row per piece of a document: where it starts, its ids, and where it lies in which sequence."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "open"]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        ids, rest = [f[0] for f in found], [f[1:] for f in found]
        columns = [list(c) for c in zip(*rest)] or [[] for _ in names[1:]]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_kind), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_encoder(tokenizer)
        windows = Windows(window, open_windows)
        sequence = TaskContext.get().partitionId() << 32
        found: list[tuple] = []

        def leave(pieces: list, is_open: bool = False) -> None:
            nonlocal sequence
            at = 0
            for piece in [*pieces, None]:
                if piece is None:
                    sequence += 1
                    at = 0
                    continue
                doc, start, ids, total = piece
                found.append((doc, start, ids.tobytes(), total, sequence, at, is_open))
                at += len(ids)

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                total, whole = len(ids), len(ids) // window * window
                for start in range(0, whole, window):
                    leave([(doc, start, ids[start : start + window], total)])
                if whole < total:
                    left = windows.place((doc, whole, ids[whole:].copy(), total), total - whole)
                    if left is not None:
                        leave(left)
                size += total
                if size > 1 << 18:
                    yield batch_of(found)
                    found, size = [], 0
        for pieces in windows.rest():
            leave(pieces, True)
        yield batch_of(found)

    schema = docs.select("doc_id").schema
    for name, of in zip(names[1:], ["long", "binary", "long", "long", "long", "boolean"]):
        schema = schema.add(name, of)
    placed = stage(docs.select("doc_id", "text").mapInArrow(run, schema))

    def merge(rows: pa.Table) -> pa.Table:
        """Join the open windows end to end and cut them anew; the last rest into powers of two."""
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        total = sum(len(i.as_py()) // 4 for i in rows.column("ids"))
        # Two numbers of sequences beside those of the partitions.
        sequence = (1 << 62) | int(rows.column("sequence_id")[0].as_py())
        room = [window] * (total // window)
        rest = total % window
        room += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        found, at, number = [], 0, 0
        for doc, start, ids, doc_tokens in zip(
            rows.column("doc_id").to_pylist(), rows.column("start").to_pylist(),
            rows.column("ids").to_pylist(), rows.column("doc_tokens").to_pylist(),
        ):
            ids = np.frombuffer(ids, "<u4")
            while len(ids):
                piece = ids[: room[number] - at]
                found.append((doc, start, piece.tobytes(), doc_tokens, sequence + number, at, False))
                start, at, ids = start + len(piece), at + len(piece), ids[len(piece) :]
                if at == room[number]:
                    number, at = number + 1, 0
        return pa.Table.from_batches([batch_of(found)])

    group = F.shiftright("sequence_id", 32).cast("long") / merge_partitions
    merged = placed.where("open").groupBy(F.floor(group).alias("part")).applyInArrow(merge, schema)
    return placed.where("not open").unionByName(merged).drop("open")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with length and CRC-32 in place of their ids."""
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
