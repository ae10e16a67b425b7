"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Tokenizer A is a byte-level BPE and reads a space and the text, B a piece model that adds
the space itself. Byte offsets where tokens of both end cut the tokens into groups; each
such offset links the two tokens that end there.

A stretch of a text is a fragment: tokens of both with their common ends. What stands
before its first end is its open prefix, what stands behind its last end its open suffix,
all between are closed groups. Fragments of neighbouring stretches compose by closing the
left one's suffix with the right one's prefix; this is associative, so a text longer than
``CHUNK_BYTES`` is cut at any byte, its ranges are tokenized by many tasks and composed as
a tree of ``FAN`` fragments a node. A range is read from the break before it to the break
behind it, where both tokenizers start anew, and keeps the tokens that end inside it.

A text whose bytes the tokens of A or B do not give back, an empty and a null text have no
tokens. Repeated rows and equal ids stay rows of their own, null ids pass; other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrank.llm.arrays import slices
from ctxrank.llm.tables import joinable
from ctxrank.session import stage

CHUNK_BYTES = 1 << 16
FAN = 8
CACHED_SEGMENTS = 150_000
# Id pairs whose counts are sent to every task: the most frequent ones, at most so many.
FREQUENT_PAIRS = 1 << 20
# Pairs a task holds before it adds them up.
HELD_PAIRS = 1 << 21
JOIN_BYTES = 32 << 20

# Both tokenizers start anew at a space behind one of these: A's pretokens never hold white
# space behind another character, and no piece of B holds its space mark behind one. A
# space at the end of a text is none: B gives no space before nothing.
SOLID = "[!-~À-ÖØ-öø-ɏ]"
BREAK = re.compile(f"(?<={SOLID}) (?!\\Z)")
SOLID_END = re.compile(f"{SOLID}\\Z")
# Fixed value: the pretokens of byte-level BPE vocabularies of this family.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# Segments encoded as one text.
JOINED = 64

RESULT = "row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
FRAGMENT = "row long, chunk long, ok boolean, a binary, b binary, cut_a binary, cut_b binary"


@dataclass(frozen=True)
class Fragment:
    """Ids of both tokenizers over a stretch; ``cut_a[i]``, ``cut_b[i]`` count those up to its i-th common end."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        end = (self.cut_a[0], self.cut_b[0]) if len(self.cut_a) else (len(self.a), len(self.b))
        return self.a[: end[0]], self.b[: end[1]]

    def suffix(self) -> tuple[np.ndarray, np.ndarray]:
        at = (self.cut_a[-1], self.cut_b[-1]) if len(self.cut_a) else (len(self.a), len(self.b))
        return self.a[at[0] :], self.b[at[1] :]

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The closed groups behind the first common end."""
        for i in range(1, len(self.cut_a)):
            yield self.a[self.cut_a[i - 1] : self.cut_a[i]], self.b[self.cut_b[i - 1] : self.cut_b[i]]

    def __add__(self, right: Fragment) -> Fragment:
        """The fragment of both stretches: this one's suffix and the other's prefix become one group."""
        return Fragment(
            np.concatenate([self.a, right.a]),
            np.concatenate([self.b, right.b]),
            np.concatenate([self.cut_a, right.cut_a + len(self.a)]),
            np.concatenate([self.cut_b, right.cut_b + len(self.b)]),
        )


EMPTY = Fragment(*[np.zeros(0, np.int64)] * 4)


def fragment(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of tokens with these ends; no token is empty, so ends rise."""
    _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    return Fragment(a, b, at_a + 1, at_b + 1)


class Pair:
    """Two tokenizer files: ids of segments between breaks, and the bytes of each id.

    Ids of A come from its vocabulary as ranks, which gives those of the tokenizer file.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        special = {token["content"] for token in content["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.bytes_a[number] = bytes(byte_of[c] for c in entry)
        ranks = {self.bytes_a[n]: n for entry, n in vocabulary.items() if entry not in special}
        self.tokenizer = tiktoken.Encoding("a", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_b = [self._piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.kind = np.dtype("<u4" if len(self.bytes_a) * len(self.bytes_b) < 1 << 32 else "<u8")
        n_a, n_b = range(len(self.bytes_a)), range(len(self.bytes_b))
        self.shown = [f"{i}," for i in n_a] + [f"{i}|" for i in n_a] + [f"{i}," for i in n_b] + [f"{i};" for i in n_b]

    def _piece_bytes(self, number: int) -> bytes:
        piece = self.pieces.id_to_piece(number)
        if self.pieces.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of each text with a space before it, None where they do not give its bytes."""
        made = []
        for text, of_b in zip(texts, self.pieces.encode(texts, num_threads=1)):
            of_a, want = self.tokenizer.encode_ordinary(" " + text), (" " + text).encode()
            whole = b"".join([self.bytes_a[i] for i in of_a]) == want == b"".join([self.bytes_b[i] for i in of_b])
            made.append((of_a, of_b) if whole else None)
        return made

    def encode_segments(self, segments: list[str]) -> tuple[list[str], Fragment, np.ndarray, np.ndarray]:
        """Segments that have tokens, one fragment of all of them, and where each ends in its a and b.

        Segments with a solid end break from what follows, so many are encoded as one text.
        """
        solid = [s for s in segments if SOLID_END.search(s)]
        batches = [solid[i : i + JOINED] for i in range(0, len(solid), JOINED)]
        batches += [[s] for s in segments if not SOLID_END.search(s)]
        found = []
        for batch, ids in zip(batches, self.encode([" ".join(b) for b in batches])):
            if ids is not None:
                found.append((batch, *ids))
            elif len(batch) > 1:
                each = zip(batch, self.encode(batch))
                found += [([s], *i) for s, i in each if i is not None]
        done = [s for f in found for s in f[0]]
        a, b = (np.array([i for f in found for i in f[j]], np.int64) for j in (1, 2))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        stops = np.cumsum([len(s.encode()) + 1 for s in done])
        whole = fragment(a, b, ends_a, ends_b)
        return done, whole, np.searchsorted(ends_a, stops) + 1, np.searchsorted(ends_b, stops) + 1

    def keys(self, whole: Fragment) -> np.ndarray:
        """The id pair of each link."""
        return (whole.a[whole.cut_a - 1] * len(self.bytes_b) + whole.b[whole.cut_b - 1]).astype(self.kind)

    def written(self, whole: Fragment) -> list[str]:
        """Per token ``a1,a2|b1;``, group by group: the ids of A, then those of B."""
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        code_a, code_b = whole.a.copy(), whole.b + 2 * n_a
        code_a[whole.cut_a - 1] += n_a
        code_b[whole.cut_b - 1] += n_b
        group_a = np.repeat(np.arange(len(whole.cut_a)), np.diff(whole.cut_a, prepend=0))
        group_b = np.repeat(np.arange(len(whole.cut_b)), np.diff(whole.cut_b, prepend=0))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shown = self.shown
        return [shown[i] for i in np.concatenate([code_a, code_b])[order].tolist()]


class Segments:
    """What is known of the segments met so far, bounded by ``CACHED_SEGMENTS``.

    Of a segment the sum n_a + n_b * 2**32, its link keys and its written groups; those
    in ``bad`` have no tokens.
    """

    def __init__(self, pair: Pair):
        self.pair = pair
        self.known: dict[str, tuple[int, bytes, str]] = {}
        self.bad: set[str] = set()

    def learn(self, new: list[str]) -> None:
        pair = self.pair
        done, whole, of_a, of_b = pair.encode_segments(new)
        self.bad.update(set(new).difference(done))
        self.known.update((s, (0, b"", "")) for s in self.bad)
        text, keys = pair.written(whole), pair.keys(whole).tobytes()
        # Every segment ends at a common end.
        ends = ((np.searchsorted(whole.cut_a, of_a) + 1) * pair.kind.itemsize).tolist()
        counts = (np.diff(of_a, prepend=0) + (np.diff(of_b, prepend=0) << 32)).tolist()
        at = at_key = 0
        for segment, n, end, end_key in zip(done, counts, (of_a + of_b).tolist(), ends):
            self.known[segment] = (n, keys[at_key:end_key], "".join(text[at:end]))
            at, at_key = end, end_key

    def align(self, texts: list[str]) -> Iterator[tuple | None]:
        """(n_a, n_b, link keys, written groups) of each text, None if it has no tokens."""
        split = [BREAK.split(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHED_SEGMENTS:
            self.known.clear()
            self.bad.clear()
            new = set().union(*split)
        self.learn(list(new))
        known, bad, kind = self.known, self.bad, self.pair.kind
        for text, parts in zip(texts, split):
            if not text or (bad and not bad.isdisjoint(parts)):
                yield None
                continue
            found = [known[p] for p in parts]
            n_b, n_a = divmod(sum([f[0] for f in found]), 1 << 32)
            keys = np.frombuffer(b"".join([f[1] for f in found]), kind)
            yield n_a, n_b, keys, "".join([f[2] for f in found])[:-1]


class Results:
    """Rows of ``RESULT`` by column."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in RESULT.split(",")]

    def add(self, row: int, n_a: int = 0, n_b: int = 0, keys: np.ndarray | None = None, groups: str = "") -> None:
        n = 0 if keys is None else len(keys)
        distinct, times = np.unique(keys, return_counts=True) if n else (np.zeros(0), np.zeros(0))
        packed = distinct.tobytes(), times.astype("<u4").tobytes()
        for column, value in zip(self.columns, (row, n_a, n_b, n, n, groups, *packed)):
            column.append(value)

    def batch(self, *ids: pa.Array) -> pa.RecordBatch:
        """The rows, each behind its document's id, and a fresh start."""
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(self.columns, kinds)]
        self.__init__()
        names = [f.split()[0] for f in RESULT.split(",")]
        return pa.RecordBatch.from_arrays([*ids, *arrays], names=["doc_id"] * len(ids) + names)


def vocabulary_size(path: str) -> int:
    """How many ids a piece model has."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def _with_result(docs: DataFrame):
    kind = docs.select("doc_id").schema
    for field in RESULT.split(","):
        kind = kind.add(*field.split())
    return kind


def _align_short(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, results = None, Results()
        for batch in batches:
            segments = segments or Segments(Pair(path_a, path_b))
            for first, end, *_ in slices(batch.column(2)):
                part = batch.slice(first, end - first)
                texts = [text or "" for text in part.column(2).to_pylist()]
                for row, found in zip(part.column(1).to_pylist(), segments.align(texts)):
                    results.add(row, *(found or ()))
                yield results.batch(part.column(0))

    return docs.select("doc_id", F.shiftleft(F.monotonically_increasing_id(), 1).alias("row"), "text").mapInArrow(
        run, _with_result(docs)
    )


def _ranges(text: str, chunk_bytes: int) -> Iterator[tuple[str, int, int, int]]:
    """(piece, offset of its space, low, high) for the byte ranges of a space and the text.

    A piece lies between the breaks around its range. Limits without a break between
    them are left out, so no byte lies in more than three pieces.
    """
    data = (" " + text).encode()
    starts = np.cumsum([0] + [len(p.encode()) + 1 for p in BREAK.split(text)])
    before = lambda limit: int(starts[np.searchsorted(starts, limit, "right") - 1])
    after = lambda limit: int(starts[np.searchsorted(starts, limit, "left")])
    limits = [0]
    for limit in range(chunk_bytes, len(data), chunk_bytes):
        if before(limit) > limits[-1]:
            limits.append(limit)
    for low, high in zip(limits, [*limits[1:], len(data)]):
        at = before(low)
        yield data[at + 1 : after(high)].decode(), at, low, high


def _align_long(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int) -> DataFrame:
    kind = docs.select("doc_id").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(*[batch.column(i) for i in range(3)]):
                found = list(_ranges(text.as_py(), chunk_bytes))
                n = len(found)
                columns = [pa.array([row.as_py()] * n), pa.array(range(n), pa.int64()), pa.array([n] * n)]
                columns += [pa.array([f[i] for f in found]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * n, doc.type), *columns], names=names)

    ranges = docs.select("doc_id", (F.shiftleft(F.monotonically_increasing_id(), 1) + 1).alias("row"), "text")
    for field in ("row", "chunk", "n_chunks"):
        kind = kind.add(field, "long")
    kind = kind.add("piece", "string").add("at", "long").add("low", "long").add("high", "long")
    names = kind.names
    # Ranges of one text are tokenized by different tasks.
    ranges = stage(ranges.mapInArrow(cut, kind).repartition("row", "chunk"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            pair = pair or Pair(path_a, path_b)
            for row, chunk, piece, at, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                (ids,) = pair.encode([piece])
                if ids is None:
                    yield _packed(row, chunk, False, EMPTY)
                    continue
                a, b = (np.array(i, np.int64) for i in ids)
                ends_a, ends_b = at + np.cumsum(pair.size_a[a]), at + np.cumsum(pair.size_b[b])
                in_a, in_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
                yield _packed(row, chunk, True, fragment(a[in_a], b[in_b], ends_a[in_a], ends_b[in_b]))

    fragments = ranges.select("row", "chunk", "piece", "at", "low", "high").mapInArrow(tokenize, FRAGMENT)
    width = ranges.agg(F.max("n_chunks")).first()[0] or 1
    while width > 1:
        fragments = (
            fragments.withColumn("node", F.floor(F.col("chunk") / FAN))
            .groupBy("row", "node")
            .applyInArrow(_compose, FRAGMENT)
        )
        width = -(-width // FAN)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, results = None, Results()
        for batch in batches:
            pair = pair or Pair(path_a, path_b)
            for row, _, ok, *arrays in zip(*[c.to_pylist() for c in batch.columns]):
                whole = _unpacked(arrays)
                if ok:
                    groups = "".join(pair.written(whole))[:-1]
                    results.add(row, len(whole.a), len(whole.b), pair.keys(whole), groups)
                else:
                    results.add(row)
                yield results.batch()

    ids = ranges.where("chunk = 0").select("doc_id", "row")
    return ids.join(fragments.mapInArrow(finish, RESULT), "row").select(*_with_result(docs).names)


def _packed(row: int, chunk: int, ok: bool, found: Fragment) -> pa.RecordBatch:
    arrays = [x.astype("<u4").tobytes() for x in (found.a, found.b, found.cut_a, found.cut_b)]
    values = [row, chunk, ok, *arrays]
    kinds = [pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array([v], k) for v, k in zip(values, kinds)], names=["row", "chunk", "ok", "a", "b", "cut_a", "cut_b"]
    )


def _unpacked(arrays: list[bytes]) -> Fragment:
    return Fragment(*[np.frombuffer(x, "<u4").astype(np.int64) for x in arrays])


def _compose(group: pa.Table) -> pa.Table:
    """One node of the tree: the fragments of at most ``FAN`` neighbours, in the order of their ranges."""
    group = group.sort_by("chunk")
    whole = EMPTY
    for arrays in zip(*[group.column(c).to_pylist() for c in ("a", "b", "cut_a", "cut_b")]):
        whole = whole + _unpacked(list(arrays))
    row, node, ok = group.column("row")[0].as_py(), group.column("node")[0].as_py(), all(group.column("ok").to_pylist())
    return pa.Table.from_batches([_packed(row, node, ok, whole)])


def align(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id and ``RESULT`` of every row: counts, the groups as ``a1,a2|b1;a3|b2``, and its distinct links.

    ``pairs`` holds the links' keys, id of A times size of B plus id of B, and ``times`` how
    often each stands in the text, as little-endian numbers.
    """
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    docs = docs.select("doc_id", "text")
    short = _align_short(docs.where(~is_long), path_a, path_b)
    return short.unionByName(_align_long(docs.where(is_long), path_a, path_b, chunk_bytes))


def _key_kind(size: int) -> np.dtype:
    return np.dtype("<u4" if size == 4 else "<u8")


def _flat(pairs: pa.Array, times: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, times and row of each link of a batch."""
    counts = [np.frombuffer(t or b"", "<u4") for t in times.to_pylist()]
    sizes = np.array([len(c) for c in counts], np.int64)
    data = [p or b"" for p in pairs.to_pylist()]
    width = max((len(p) // len(c) for p, c in zip(data, counts) if len(c)), default=4)
    keys = np.frombuffer(b"".join(data), _key_kind(width)).astype(np.int64)
    return keys, np.concatenate([*counts, np.zeros(0, "<u4")]).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how often each id pair is linked, and whether no pair of its B id is more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added_up() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, *[h[0] for h in held]])
            distinct, at = np.unique(every, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, at, np.concatenate([counts, *[h[1] for h in held]]))
            return distinct, total

        waiting = 0
        for batch in batches:
            new_keys, new_counts, _ = _flat(batch.column(0), batch.column(1))
            held.append((new_keys, new_counts))
            waiting += len(new_keys)
            if waiting > HELD_PAIRS:
                keys, counts = added_up()
                held, waiting = [], 0
                if len(keys) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = added_up()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    pairs = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stage(pairs.withColumn("id_b", F.col("pair") % size_b))
    # One row for each id of B's vocabulary.
    highest = pairs.groupBy("id_b").agg(F.max("n").alias("highest"))
    return stage(
        pairs.join(F.broadcast(highest), "id_b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    )


def _frequent_from(pairs: DataFrame, limit: int) -> int:
    """The smallest power of two such that at most ``limit`` pairs are linked at least so often."""
    sizes = pairs.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()
    least, n = 64, 0
    for row in sorted(sizes, key=lambda r: -r["bits"]):
        n += row["count"]
        if n > limit:
            break
        least = row["bits"]
    return min(1 << (least - 1), (1 << 63) - 1)


def with_pair_counts(aligned: DataFrame, size_b: int, frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of pairs and times.

    The counts of frequent pairs are sent to every task, at most ``frequent_pairs`` of
    them; links of the others, each of them rare, are joined with their counts.
    """
    aligned = stage(aligned)
    pairs = pair_counts(aligned, size_b)
    least = _frequent_from(pairs, frequent_pairs)
    top = pairs.where(F.col("n") >= least).orderBy("pair").toArrow()
    columns = [top.column(c).to_numpy() for c in ("pair", "n", "best")]
    shared = aligned.sparkSession.sparkContext.broadcast(columns)

    def looked_up(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
        keys, times, row_of = _flat(batch.column(at), batch.column(at + 1))
        pair, n, best = shared.value
        place = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
        known = pair[place] == keys if len(pair) else np.zeros(len(keys), bool)
        return keys, times, row_of, known, place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = len(batch.columns)
            _, times, row_of, known, place = looked_up(batch, last - 2)
            _, n, best = shared.value
            row_of, times, place = row_of[known], times[known], place[known]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row_of, times * best[place])
            np.add.at(sums[1], row_of, times * n[place])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: last - 2], pa.array(sums[0]), pa.array(sums[1])], names=names
            )

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, times, row_of, known, _ = looked_up(batch, 1)
            rows = batch.column(0).to_numpy()[row_of[~known]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(keys[~known]), pa.array(times[~known])], names=["row", "pair", "times"]
            )

    kept = aligned.select(*[c for c in aligned.columns if c not in ("pairs", "times")], "pairs", "times")
    kind = kept.drop("pairs", "times").schema.add("n_best", "long").add("count_sum", "long")
    names = kind.names
    counted = kept.mapInArrow(run, kind)
    others = pairs.where(F.col("n") < least)
    if others.isEmpty():
        return counted
    links = aligned.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times long")
    rest = (
        links.join(joinable(others, JOIN_BYTES), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"),
            F.sum(F.col("times") * F.col("n")).alias("rare_sum"),
        )
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    whole = counted.join(rest, "row", "left")
    kept_columns = [c for c in counted.columns if c not in ("n_best", "count_sum")]
    return whole.select(*kept_columns, plus("n_best", "rare_best"), plus("count_sum", "rare_sum"))
