"""Quality classifier: labelled neighbours in a latent-semantic space vote.

A text is its byte trigrams, hashed into ``BUCKETS`` counts, and four shares of
repeated words, lines and symbols. Counts are weighted by their inverse document
frequency over all documents, shares by a fixed weight, and the whole is projected on the leading
singular vectors of a bounded sample of labelled documents. The sample's vectors are
broadcast; every document's cosines with all of them come from blocked products, and
the labels of the nearest vote with weights that grow with the cosine.

Null and empty texts have no trigrams and get the share of label 1 in the sample, as
does every text when there is no sample (then 0.5). Rows are scored one by one, so
repeated rows, null ids and ties give the same score wherever they stand. Null labels
are not learned from. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxrank.llm.arrays import slices
from ctxrank.llm.statistics import COUNTS, counts as text_counts

BUCKETS = 4096
# Shares of words like the last, of words in repeated windows, of symbols, of repeated lines.
SHAPES = 4
SHAPE_WEIGHT = 4.0
TERMS = BUCKETS + SHAPES
DIMENSIONS = 48
# The learner's sample: at most so many labelled documents, those with the smallest hashes.
SAMPLE_ROWS = 4096
NEIGHBOURS = 15
SHARPNESS = 8.0
# More than the rounding of a cosine.
MARGIN = 1e-5
# Rows whose counts stand in memory at once.
PIECE_ROWS = 1024

_codes = np.random.default_rng(7).integers(0, 2**31, (3, 256), dtype=np.uint32)


def trigram_counts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often each bucket's trigrams stand in each row: a row per text, a column per bucket."""
    n = len(rows) - 1
    if len(data) < 3:
        return np.zeros((n, BUCKETS), np.float32)
    bucket = _codes[0][data[:-2]] + _codes[1][data[1:-1]] + _codes[2][data[2:]]
    bucket = (bucket * np.uint32(2654435761)) >> np.uint32(32 - 12)
    row_of = np.repeat(np.arange(n), np.diff(rows))
    inside = row_of[:-2] == row_of[2:]
    cells = row_of[:-2][inside] * BUCKETS + bucket[inside]
    return np.bincount(cells, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)


def term_counts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Trigram counts of each row and, in percent, its shapes."""
    of = dict(zip(COUNTS, text_counts(data, rows)))
    n, lines = np.maximum(of["n_words"], 1), np.maximum(of["n_lines"], 1)
    shares = [of["n_same_as_last"] / n, of["n_repeat_words"] / n, of["n_symbols"] / n, of["n_dup_lines"] / lines]
    shapes = np.floor(100 * np.stack(shares, 1)).astype(np.float32)
    return np.concatenate([trigram_counts(data, rows), shapes], axis=1)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=rows, where=norm > 0)


@dataclass(frozen=True)
class Model:
    """Weights, projection and labelled vectors: sized by the constants above, not by the data."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def score(self, counts: np.ndarray) -> np.ndarray:
        scores = np.full(len(counts), self.prior)
        filled = np.flatnonzero(counts.any(axis=1))
        if not len(self.labels) or not len(filled):
            return scores
        rows = weighted(counts[filled], self.idf)
        # Row by row, so that a text's vector does not depend on its batch.
        places = [np.flatnonzero(row) for row in rows]
        latent = _unit(np.stack([row[at] @ self.projection[at] for row, at in zip(rows, places)]))
        cosines = latent @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        kth = -np.partition(-cosines, k - 1, axis=1)[:, k - 1]
        # What may be among the nearest is scored again in a fixed order; ties go by the sample's order.
        row, near = np.nonzero(cosines >= (kth - MARGIN)[:, None])
        exact = (latent[row].astype(float) * self.vectors[near]).sum(axis=1)
        order = np.lexsort((near, -exact, row))
        row, near, exact = row[order], near[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, near, exact = row[first], near[first], exact[first]
        weight = np.exp(SHARPNESS * (exact - 1.0))
        total, yes = np.bincount(row, weight), np.bincount(row, weight * self.labels[near])
        scores[filled] = yes / total
        return np.clip(scores, 0.0, 1.0)


def pieces(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most ``PIECE_ROWS`` rows."""
    for first in range(0, len(rows) - 1, PIECE_ROWS):
        part = rows[first : first + PIECE_ROWS + 1]
        yield first, first + len(part) - 1, data[part[0] : part[-1]], part - part[0]


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket has a trigram, over all documents, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for first, end, data, rows in slices(batch.column(0)):
                for *_, some, offsets in pieces(data, rows):
                    seen += (trigram_counts(some, offsets) > 0).sum(0)
                n += end - first
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], seen]))], names=["bucket", "n"]
        )

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = {row["bucket"]: row["n"] for row in counted.collect()}
    return np.array([totals.get(b, 0) for b in range(BUCKETS)], float), totals.get(-1, 0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model for ``labels.quality``, from a bounded sample of the labelled documents."""
    known = (
        labels.where("doc_id is not null and quality is not null")
        .select("doc_id", "quality")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                found = []
                for line in (line for *_, some, places in pieces(data, offsets) for line in term_counts(some, places)):
                    at = np.flatnonzero(line)
                    found.append(np.stack([at, line[at]]).astype("<u4").tobytes())
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.binary())], names=["doc_id", "quality", "counts"]
                )

    kind = rows.select("doc_id", "quality").schema.add("counts", "binary")
    # Copies of an id could exceed the sample's bound.
    sample = (
        rows.select("doc_id", "quality", "text")
        .mapInArrow(run, kind)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "counts")
        .limit(sample_rows)
        .select("quality", "counts")
        .toArrow()
    )
    seen, n = document_frequencies(docs)
    idf = np.append(np.log((1.0 + n) / (1.0 + seen)), [SHAPE_WEIGHT] * SHAPES).astype(np.float32)
    counts = np.zeros((sample.num_rows, TERMS), np.float32)
    for i, packed in enumerate(sample.column("counts")):
        at, values = np.frombuffer(packed.as_py(), "<u4").reshape(2, -1)
        counts[i, at] = values
    rows_of_sample = weighted(counts, idf)
    projection = _leading_directions(rows_of_sample)
    vectors = _unit(rows_of_sample @ projection)
    return Model(idf, projection, vectors, (sample.column("quality").to_numpy() > 0).astype(float))


def _leading_directions(rows: np.ndarray) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    if not len(rows):
        return np.zeros((TERMS, 1), np.float32)
    size = min(DIMENSIONS, len(rows))
    basis = np.random.default_rng(1).standard_normal((rows.shape[1], size + 8)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :size])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: how likely label 1 is, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.projection, model.vectors, model.labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for first, end, data, rows in slices(batch.column(1)):
                scores = np.concatenate([model.score(term_counts(some, offsets)) for *_, some, offsets in pieces(data, rows)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(scores)], names=["doc_id", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept from the learner; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
