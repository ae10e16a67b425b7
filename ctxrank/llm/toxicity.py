"""Toxicity: the nearest labelled examples by exact TF-IDF cosine vote.

Terms are the lower-cased words of a text, of ASCII letters and digits and of all beyond
ASCII, and the first ``PREFIXES`` code points of longer words; a term that stands often
and densely in a text gives terms of higher ``LEVELS`` besides. The vocabulary holds the
terms that labels bind to toxic texts, by chi-square over a bounded sample of labelled
documents; a term's weight is (1 + ln tf) times its inverse document frequency over all
documents. The rest of the sample calibrates the votes.

Labelled examples lie in blocks of similar ones, in an inverted index with each term's
maximal weight by block. A document's blocks are searched from the highest bound down,
until no bound reaches its k-th best cosine: the nearest are exact, ties go to the smaller
id. Votes weigh the square of the cosine, are drawn to the labels' share where the
evidence is thin, and pass a logistic calibration.

A null or empty text and one without a term of the vocabulary have no evidence and get
the score of none; without labels every score is the prior, 0.5 without any. Rows are
scored one by one, so repeated rows and null ids score alike wherever they stand. Null
labels teach nothing, an id with two labels counts as toxic if one is. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrank.llm.arrays import ALPHANUMERIC, mix, prefix_sums, signed, slices, window_hashes, words
from ctxrank.llm.statistics import CHARACTER
from ctxrank.session import stage

PREFIXES = (3, 4, 5, 7)
# A term of level i + 1 stands at least LEVELS[i][0] times and once in LEVELS[i][1] words.
LEVELS = ((1, 1 << 40), (2, 200), (3, 100))
# The learner's sample: at most so many labelled documents of each class, those with the
# smallest hashes; one in CALIBRATION of them calibrates and is no example.
TOXIC_ROWS = 4096
CLEAN_ROWS = 8192
CALIBRATION = 4
# The vocabulary: terms of at least MIN_TOXIC different toxic texts and this chi-square, the best ones.
MIN_TOXIC = 3
CANDIDATES = 1 << 16
CHI_SQUARE = 25.0
# A term's share among toxic texts is at least so many times that among others.
MIN_LIFT = 4.0
VOCABULARY = 2048
NEIGHBOURS = 15
EVIDENCE = 3
# How many votes of a perfect match the labels' share weighs.
PRIOR_VOTES = 0.5
BLOCK = 64
# Cells of bounds or scores made at once.
CELLS = 1 << 20


_LEVEL = np.uint64(3)


def terms(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each word and of its prefixes, the last two bits zero, and each row's number of words."""
    starts, ends, row_of = words(data, rows, ALPHANUMERIC)
    sums = prefix_sums(data, fold_case=True)
    hashes, of = [window_hashes(sums, starts, ends)], [row_of]
    at = np.flatnonzero(CHARACTER[data])
    nth = np.cumsum(CHARACTER[data])
    first, last = nth[starts] - 1, nth[ends - 1] - 1
    for size in PREFIXES:
        longer = last - first >= size
        cut = at[first[longer] + size]
        hashes.append(mix(window_hashes(sums, starts[longer], cut) ^ np.uint64(size)))
        of.append(row_of[longer])
    return np.concatenate(hashes) & ~_LEVEL, np.concatenate(of), np.bincount(row_of, minlength=len(rows) - 1)


def leveled(
    hashes: np.ndarray, row_of: np.ndarray, n_words: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times): the distinct terms of each row, each on all its levels, by row."""
    order = np.lexsort((hashes, row_of))
    hashes, row_of = hashes[order], row_of[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row_of[1:] != row_of[:-1])
    at = np.flatnonzero(fresh)
    term, row, times = hashes[at], row_of[at], np.diff(np.append(at, len(hashes)))
    reached = [(times >= least) & (times * within >= n_words[row]) for least, within in LEVELS]
    found = [np.concatenate([x[r] for r in reached]) for x in (row, term, times)]
    found[1] = found[1] | np.repeat(np.arange(len(LEVELS), dtype=np.uint64), [r.sum() for r in reached])
    order = np.lexsort((found[1], found[0]))
    return found[0][order], found[1][order], found[2][order]


@dataclass(frozen=True)
class Rows:
    """Sparse rows: the terms and values of row i stand at ``starts[i] : starts[i + 1]``, terms ascending."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, chosen: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[chosen]
        at = _spread(self.starts[:-1][chosen], sizes)
        return Rows(np.concatenate([[0], np.cumsum(sizes)]), self.terms[at], self.values[at])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each stretch, one stretch after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def weighted(counts: Rows, idf: np.ndarray) -> Rows:
    """Unit TF-IDF rows."""
    values = (1.0 + np.log(np.maximum(counts.values, 1.0))) * idf[counts.terms]
    row_of = np.repeat(np.arange(len(counts)), np.diff(counts.starts))
    norms = np.sqrt(np.bincount(row_of, weights=values * values, minlength=len(counts)))
    return Rows(counts.starts, counts.terms, values / np.maximum(norms[row_of], 1e-300))


@dataclass(frozen=True)
class BlockMaxIndex:
    """Postings of the examples by term and block, and each term's maximal weight in each block."""

    numbers: np.ndarray
    at: np.ndarray
    positions: np.ndarray
    weights: np.ndarray
    maxima: np.ndarray

    @staticmethod
    def build(examples: Rows, n_terms: int) -> BlockMaxIndex:
        """Examples whose heaviest terms agree share a block, so that few blocks have high bounds."""
        row_of = np.repeat(np.arange(len(examples)), np.diff(examples.starts))
        heavy = np.lexsort((examples.terms, -examples.values, row_of))
        ranks = [np.full(len(examples), n_terms) for _ in range(2)]
        for j, rank in enumerate(ranks):
            has = np.diff(examples.starts) > j
            rank[has] = examples.terms[heavy[examples.starts[:-1][has] + j]]
        numbers = np.lexsort((np.arange(len(examples)), ranks[1], ranks[0]))
        ordered = examples.take(numbers)
        n_blocks = -(-len(ordered) // BLOCK)
        position = np.repeat(np.arange(len(ordered)), np.diff(ordered.starts))
        cell = ordered.terms.astype(np.int64) * n_blocks + position // BLOCK
        order = np.lexsort((position, cell))
        at = np.searchsorted(cell[order], np.arange(n_terms * n_blocks + 1))
        maxima = np.zeros(n_terms * n_blocks)
        np.maximum.at(maxima, cell, ordered.values)
        maxima = maxima.reshape(n_terms, n_blocks)
        return BlockMaxIndex(numbers, at, position[order], ordered.values[order], maxima)

    @property
    def n_blocks(self) -> int:
        return self.maxima.shape[1]

    def nearest(self, queries: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, example number, cosine) of each query's ``k`` nearest, best first, and the pairs of query and block searched.

        Examples without a common term are no neighbours.
        """
        parts, searched = [], 0
        sizes = np.diff(queries.starts)
        step = max(1, CELLS // max(self.n_blocks, 1))
        filled, low = np.flatnonzero(sizes > 0) if self.n_blocks else np.zeros(0, int), 0
        while low < len(filled):
            room = np.searchsorted(np.cumsum(sizes[filled[low : low + step]]), step, "right")
            chosen = filled[low : low + max(1, int(room))]
            query, number, cosine, n = self._nearest(queries.take(chosen), k)
            parts.append((chosen[query], number, cosine))
            searched += n
            low += len(chosen)
        if not parts:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0
        return *[np.concatenate(p) for p in zip(*parts)], searched

    def _nearest(self, queries: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        n = len(queries)
        bounds = np.add.reduceat(self.maxima[queries.terms] * queries.values[:, None], queries.starts[:-1], axis=0)
        # Sums of the same products in another order may differ in their last bits.
        bounds *= 1 + 1e-12
        blocks = np.argsort(-bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, blocks, 1)
        best = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        floor, nth, searched = np.zeros(n), np.zeros(n, int), 0
        active = np.arange(n)
        while len(active):
            query, block = active, blocks[active, nth[active]]
            number, cosine, owner = self._scores(queries, query, block)
            searched += len(query)
            query, number, cosine = (np.concatenate(p) for p in zip(best, (owner, number, cosine)))
            order = np.lexsort((number, -cosine, query))
            query, number, cosine = query[order], number[order], cosine[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            floor[query[rank == k - 1]] = cosine[rank == k - 1]
            keep = rank < k
            best = query[keep], number[keep], cosine[keep]
            nth[active] += 1
            active = active[nth[active] < self.n_blocks]
            bound = bounds[active, nth[active]]
            active = active[(bound > 0) & (bound >= floor[active])]
        return *best, searched

    def _scores(self, queries: Rows, query: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(example number, cosine, query) of the examples of each query's block that share a term with it."""
        sizes = np.diff(queries.starts)[query]
        entry = _spread(queries.starts[:-1][query], sizes)
        pair = np.repeat(np.arange(len(query)), sizes)
        cell = queries.terms[entry].astype(np.int64) * self.n_blocks + block[pair]
        counts = self.at[cell + 1] - self.at[cell]
        posting = _spread(self.at[cell], counts)
        place = np.repeat(pair * BLOCK - block[pair] * BLOCK, counts) + self.positions[posting]
        products = np.repeat(queries.values[entry], counts) * self.weights[posting]
        # Products of one pair are added in the order of its terms, whatever else is in the batch.
        scores = np.bincount(place, weights=products, minlength=len(query) * BLOCK)
        found = np.unique(place)
        return self.numbers[found % BLOCK + BLOCK * block[found // BLOCK]], scores[found], query[found // BLOCK]


@dataclass(frozen=True)
class Model:
    """Vocabulary, index and calibration: sized by the constants above, not by the data."""

    vocabulary: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex
    ids: pa.Array
    toxic: np.ndarray
    weight: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def votes(self, counts: Rows) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The share of weighted votes for toxic, and the neighbours that voted."""
        query, number, cosine, _ = self.index.nearest(weighted(counts, self.idf), NEIGHBOURS)
        votes = cosine * cosine * self.weight[number]
        total = np.bincount(query, weights=votes, minlength=len(counts))
        yes = np.bincount(query, weights=votes * self.toxic[number], minlength=len(counts))
        return (yes + PRIOR_VOTES * self.prior) / (total + PRIOR_VOTES), (query, number, cosine)

    def packed(self) -> tuple:
        """Plain values for a broadcast, which workers can read without this package."""
        return *[v for v in vars(self).values() if v is not self.index], tuple(vars(self.index).values())

    @staticmethod
    def unpacked(values: tuple) -> Model:
        vocabulary, idf, *rest, index = values
        return Model(vocabulary, idf, BlockMaxIndex(*index), *rest)

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * _logit(share) + self.shift)))


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def calibration(share: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from shares to labels, by Newton's method with smoothed labels."""
    if not toxic.any() or toxic.all():
        return 1.0, 0.0
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([_logit(share), np.ones(len(share))], 1)
    theta = np.array([1.0, 0.0])
    # A weak pull to the uncalibrated curve keeps few labels from an extreme one.
    pull = 0.1 * np.eye(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (target - p)) - pull @ (theta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + pull
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        theta = theta + step
        if np.abs(step).max() < 1e-10:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def _sample(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Ids and labels of the learner's sample, and how many labelled ids each class has."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        for label, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))
    ]
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION)) == 0
    return stage(parts[0].unionByName(parts[1]).withColumn("calibrates", calibrates)), sizes


def _distinct_terms(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(toxic, terms) of the sample's texts that are to be examples, copies once.

    Otherwise a text with many copies would fill the vocabulary with its own words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, rows in slices(batch.column(1)):
                row_of, term, _ = leveled(*terms(data, rows))
                cuts = np.searchsorted(row_of, np.arange(1, end - first))
                found = [t.tobytes() for t in np.split(term, cuts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(found, pa.binary())], names=["toxic", "terms"]
                )

    rows = docs.select("doc_id", "text").join(F.broadcast(sample.where("not calibrates")), "doc_id")
    return stage(rows.select("toxic", "text").mapInArrow(run, "toxic int, terms binary").distinct())


def _vocabulary(found: DataFrame) -> np.ndarray:
    """Hashes of the terms bound to toxic examples."""

    def count(among: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
                if among is not None:
                    every = every[np.isin(every, among)]
                distinct, n = np.unique(every, return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(distinct), pa.array(n)], names=["term", "n"])

        return run

    def counts(toxic: int, among: np.ndarray | None) -> DataFrame:
        rows = found.where(F.col("toxic") == toxic).select("terms").mapInArrow(count(among), "term long, n long")
        return rows.groupBy("term").agg(F.sum("n").alias("n"))

    sizes = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    top = counts(1, None).where(F.col("n") >= MIN_TOXIC).orderBy(F.desc("n"), "term").limit(CANDIDATES).toArrow()
    term, in_toxic = top.column("term").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(term)
    term, in_toxic = term[order], in_toxic[order]
    clean = counts(0, term.view(np.uint64)).toArrow()
    in_clean = np.zeros(len(term), np.int64)
    in_clean[np.searchsorted(term, clean.column("term").to_numpy())] = clean.column("n").to_numpy()
    a, b, c, d = (x.astype(float) for x in (in_toxic, in_clean, n1 - in_toxic, n0 - in_clean))
    chi = (n1 + n0) * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * n0, 1.0)
    bound = np.flatnonzero((a * n0 >= MIN_LIFT * b * n1) & (chi >= CHI_SQUARE))
    best = bound[np.lexsort((term[bound], -chi[bound]))][:VOCABULARY]
    return np.sort(term[best].view(np.uint64))


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, terms, counts) of every row: which terms of the vocabulary stand in it how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        bases = np.unique(known & ~_LEVEL)
        # Most terms are ruled out by their first 16 bits.
        likely = np.zeros(1 << 16, bool)
        likely[bases >> np.uint64(48)] = True
        for batch in batches:
            for first, end, data, rows in slices(batch.column(1)):
                hashes, of, n_words = terms(data, rows)
                maybe = likely[hashes >> np.uint64(48)]
                row_of, term, times = leveled(hashes[maybe], of[maybe], n_words)
                place = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
                right = known[place] == term if len(known) else np.zeros(len(term), bool)
                row_of, term, times = row_of[right], place[right], times[right]
                cuts = np.searchsorted(row_of, np.arange(1, end - first))
                packed = [
                    pa.array([x.astype("<u4").tobytes() for x in np.split(v, cuts)], pa.binary()) for v in (term, times)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *packed], names=names)

    kind = docs.select("doc_id").schema.add("terms", "binary").add("counts", "binary")
    names = kind.names
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _rows(term: pa.Array, counts: pa.Array) -> Rows:
    found = [[np.frombuffer(x, "<u4") for x in column.to_pylist()] for column in (term, counts)]
    sizes = [len(x) for x in found[0]]
    none = np.zeros(0, np.int64)
    joined = [np.concatenate([none, *x]) for x in found]
    return Rows(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), joined[0].astype(np.int64), joined[1].astype(float))


def document_frequencies(counted: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, over all documents, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            seen[:n_terms] += np.bincount(every, minlength=n_terms)
            seen[n_terms] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms + 1)), pa.array(seen)], names=["term", "n"])

    rows = counted.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    totals = {r["term"]: r["n"] for r in rows.collect()}
    return np.array([totals.get(t, 0) for t in range(n_terms)], float), totals.get(n_terms, 0)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model for ``labels.toxic``, and the staged ``term_counts`` of all documents."""
    sample, sizes = _sample(labels)
    vocabulary = _vocabulary(_distinct_terms(docs, sample))
    counted = stage(term_counts(docs, vocabulary))
    frequency, n = document_frequencies(counted, len(vocabulary))
    idf = np.log((2.0 + n) / (1.0 + frequency))
    # Copies of an id could exceed the sample's bound.
    rows = (
        counted.join(F.broadcast(sample), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "terms", "counts")
        .limit(TOXIC_ROWS + CLEAN_ROWS)
        .orderBy("doc_id", "terms", "counts")
        .toArrow()
        .combine_chunks()
    )
    toxic = rows.column("toxic").to_numpy().astype(float)
    held = rows.column("calibrates").to_numpy().astype(bool)
    found = _rows(rows.column("terms"), rows.column("counts"))
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    prior = (n1 + 0.5) / (n1 + n0 + 1.0)
    weight = np.where(toxic > 0, n1 / max(toxic.sum(), 1), n0 / max((1 - toxic).sum(), 1))
    weight = weight / weight.min() if len(weight) else weight
    mine = np.flatnonzero(~held)
    index = BlockMaxIndex.build(weighted(found.take(mine), idf), len(vocabulary))
    ids = rows.column("doc_id").combine_chunks().take(pa.array(mine))
    model = Model(vocabulary, idf, index, ids, toxic[mine], weight[mine], prior)
    others = np.flatnonzero(held)
    slope, shift = calibration(model.votes(found.take(others))[0], toxic[others], weight[others])
    return Model(vocabulary, idf, index, ids, toxic[mine], weight[mine], prior, slope, shift), counted


def score(counted: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence) of every row of ``term_counts``: how likely it is toxic, and its nearest examples."""
    shared = counted.sparkSession.sparkContext.broadcast(model.packed())
    ids = counted.select("doc_id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.unpacked(shared.value)
        for batch in batches:
            found = _rows(batch.column(1), batch.column(2))
            share, (query, number, cosine) = model.votes(found)
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            query, number, cosine = (x[rank < EVIDENCE] for x in (query, number, cosine))
            near = pa.StructArray.from_arrays(
                [model.ids.take(pa.array(number)), pa.array(cosine), pa.array(model.toxic[number] > 0)],
                names=["doc_id", "similarity", "toxic"],
            )
            offsets = np.searchsorted(query, np.arange(len(found) + 1)).astype(np.int32)
            evidence = pa.ListArray.from_arrays(pa.array(offsets), near)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.calibrated(share)), evidence], names=["doc_id", "score", "evidence"]
            )

    kind = ids["doc_id"].dataType.simpleString()
    near = f"array<struct<doc_id: {kind}, similarity: double, toxic: boolean>>"
    return counted.select("doc_id", "terms", "counts").mapInArrow(run, f"doc_id {kind}, score double, evidence {near}")
