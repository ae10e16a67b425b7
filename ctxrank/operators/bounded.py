"""Exact first-stage search that skips blocks of documents by upper bounds.

Documents lie in blocks of similar ones with what bounds their scores: a centroid and a
radius for vectors, each term's largest and smallest weight for term weights. A search
takes the blocks with the highest bounds first and so gets a floor under every query's
k-th best score; then it reads all blocks and multiplies only those whose bound reaches
the floor. What is left out could not have been among the k best, so the hits are
those of ``dense_topk`` and ``sparse_topk``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxrank.functions.vectors import as_matrix
from ctxrank.operators.ranking import top_k
from ctxrank.operators.search import _blocks, _hit_schema, _in_few_tasks, _merge
from ctxrank.session import BROADCAST_BYTES, broadcast_within, stage

# Documents a block, and vectors from which the clusters of blocks are found.
DOCUMENTS = 128
SAMPLE_ROWS = 20_000
FIRST_BLOCKS = 4
# Entries of an index that a task sorts.
TASK_ENTRIES = 1_000_000
# Bounds and products held back before they are merged.
ENTRIES = 4_000_000


# --- blocks ----------------------------------------------------------------


def _clusters(rows, count: int, rounds: int = 8):
    """Centres of a bounded sample, by a few rounds of nearest means from its farthest points."""
    import numpy as np

    if not len(rows):
        return np.zeros((1, rows.shape[1] if rows.ndim == 2 else 1))
    r = np.random.default_rng(0)
    chosen, near = [int(r.integers(len(rows)))], np.full(len(rows), np.inf)
    for _ in range(min(count, len(rows)) - 1):
        near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    centres = rows[chosen]
    for _ in range(rounds):
        own = _nearest(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(rows, centres):
    return ((centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)


def dense_blocks(
    docs: DataFrame, size: int = DOCUMENTS, clusters: int = 64, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``(block, centroid, radius, docids, vecs)`` of ``docs(docid, vec)``, staged.

    Clusters come from a bounded sample, those with the smallest hashes; all documents are
    dealt to them, a cluster of any size to as many tasks as its share asks for, and cut
    into blocks of ``size``. A block's vectors stand one after the other in ``vecs``.
    """
    spark = docs.sparkSession
    docs = docs.select("docid", "vec").where("vec is not null")
    sample = docs.orderBy(F.xxhash64("docid"), "docid").limit(sample_rows).select("vec").toArrow().combine_chunks()
    vectors = as_matrix(sample.column("vec").chunk(0)) if sample.num_rows else None
    if vectors is None:
        return stage(spark.createDataFrame([], _dense_schema(docs)))
    shared = spark.sparkContext.broadcast(_clusters(vectors, clusters))
    kind = T.StructType([*docs.schema.fields, T.StructField("cluster", T.IntegerType())])

    def deal(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                own = _nearest(as_matrix(batch.column(1), width=shared.value.shape[1]), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=kind.names)

    dealt = stage(docs.mapInArrow(deal, kind))
    order = ["cluster", F.xxhash64("docid")]
    grouped = dealt.repartitionByRange(*order).sortWithinPartitions("cluster", "docid")

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for table in _runs(batches, "cluster", size):
            rows = as_matrix(table.column("vec").combine_chunks())
            centroid = rows.mean(axis=0)
            radius = float(np.sqrt(((rows - centroid) ** 2).sum(axis=1)).max())
            yield _one_row(table.column("docid"), centroid, radius, rows.ravel())

    parts = grouped.mapInArrow(cut, T.StructType(_dense_schema(docs).fields[1:]))
    return stage(parts.withColumn("block", F.monotonically_increasing_id()).select(*_dense_schema(docs).names))


def _dense_schema(docs: DataFrame) -> T.StructType:
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType().add("block", T.LongType()).add("docids", T.ArrayType(docs.schema["docid"].dataType))
    return schema.add("centroid", numbers).add("radius", T.DoubleType()).add("vecs", numbers)


def _runs(batches: Iterator, column: str, size: int) -> Iterator:
    """Tables of at most ``size`` neighbouring rows with the same value of ``column``."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        values = held.column(column).to_numpy()
        if not len(values):
            continue
        starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
        cuts = [c for a, b in zip(starts, starts[1:]) for c in range(a, b, size)] + [len(values)]
        # The last run may go on in the next batch.
        for low, high in zip(cuts[:-2], cuts[1:-1]):
            yield held.slice(low, high - low).combine_chunks()
        held = held.slice(cuts[-2])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _one_row(docids, *values):
    import numpy as np
    import pyarrow as pa

    ids = docids.combine_chunks() if hasattr(docids, "combine_chunks") else docids
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    arrays = [pa.array([v.tolist()] if isinstance(v, np.ndarray) else [v]) for v in values]
    return pa.RecordBatch.from_arrays([ids, *arrays], names=["docids", *map(str, range(len(values)))])


def sparse_blocks(index: DataFrame, size: int = DOCUMENTS) -> DataFrame:
    """``(block, docids, sizes, terms, weights, bound_terms, highs, lows)`` of a ``term_index``, staged.

    Documents are ordered by their heaviest term, so that a block's documents share
    terms. Its entries stand document after document, ``sizes`` of them each. They are sorted
    in tasks of about ``TASK_ENTRIES``, however large the index is.
    """
    kind = T.StructType().add("block", T.LongType()).add("docids", T.ArrayType(index.schema["docid"].dataType))
    kind = kind.add("sizes", T.ArrayType(T.IntegerType())).add("terms", index.schema["terms"].dataType)
    numbers = T.ArrayType(T.DoubleType())
    kind = kind.add("weights", numbers).add("bound_terms", index.schema["terms"].dataType)
    kind = kind.add("highs", numbers).add("lows", numbers)
    place = F.array_position("weights", F.array_max("weights")).cast("int")
    rows = index.select("docid", "terms", "weights", F.try_element_at("terms", place).alias("heaviest"))
    rows = stage(rows)
    entries = rows.select(F.sum(F.size("terms"))).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES))
    rows = rows.repartitionByRange(tasks, "heaviest", F.xxhash64("docid")).sortWithinPartitions("heaviest", "docid")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                terms, weights = part.column(1).flatten(), part.column(2).flatten()
                entries = pa.table({"t": terms, "w": weights}).group_by("t").aggregate([("w", "max"), ("w", "min")])
                sizes = part.column(1).value_lengths().fill_null(0)
                columns = [part.column(0), sizes, terms, weights, *[entries.column(c).combine_chunks() for c in ("t", "w_max", "w_min")]]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays(lists, names=kind.names[1:])

    parts = rows.mapInArrow(cut, T.StructType(kind.fields[1:]))
    return stage(parts.withColumn("block", F.monotonically_increasing_id()).select(*kind.names))


# --- search ----------------------------------------------------------------


def _search(
    qids, blocks: DataFrame, bound_columns: list[str], bounds: Callable, scores: Callable, k: int,
    schema: T.StructType, first_blocks: int,
) -> DataFrame:
    """The hits of one block of queries: first blocks, floors, then all blocks whose bounds reach them.

    ``bounds(batch)`` gives an upper bound for every row of a batch and query, and
    ``scores(batch, row, queries, floor)`` (query, document, score) of the documents of a
    row, at least of those that reach the floor, if there is one.
    """
    import numpy as np

    spark, count = blocks.sparkSession, len(qids)
    chosen_kind = "query int, block long, score double"

    def best_blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, floor, n = [], np.full(count, -np.inf), 0
        for batch in batches:
            bound = bounds(batch)
            row, query = np.nonzero((bound >= floor[None, :]) & (bound > -np.inf))
            held.append((query, bound[row, query], batch.column(0).to_numpy()[row]))
            n += len(row)
            if n > ENTRIES:
                held = _merge(held, floor, first_blocks)
                n = sum(len(h[0]) for h in held)
        for query, bound, block in _merge(held, floor, first_blocks):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query.astype(np.int32)), pa.array(block), pa.array(bound)], names=["query", "block", "score"]
            )

    found = blocks.select("block", *bound_columns).mapInArrow(best_blocks, chosen_kind)
    first = stage(top_k(found.withColumnRenamed("block", "docid"), first_blocks, ["query"]))
    wanted = first.groupBy(F.col("docid").alias("block")).agg(F.collect_list("query").alias("queries"))

    def score_first(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(len(batch.columns) - 1)
            for row in range(batch.num_rows):
                query, _, score = scores(batch, row, np.sort(lists[row].values.to_numpy()), None)
                keep = np.lexsort((-score, query))
                place = np.arange(len(keep)) - np.searchsorted(query[keep], query[keep])
                keep = keep[place < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query[keep].astype(np.int32)), pa.array(np.arange(len(keep))), pa.array(score[keep])],
                    names=["query", "docid", "score"],
                )

    side = stage(wanted)
    opened = blocks.join(broadcast_within(side) or side, "block").select(*blocks.columns, "queries")
    scored = opened.mapInArrow(score_first, "query int, docid long, score double")
    floors = top_k(scored, k, ["query"]).where(F.col("rank") == k).select("query", "score").toArrow()
    start = np.full(count, -np.inf)
    start[floors.column("query").to_numpy()] = floors.column("score").to_numpy()
    shared = spark.sparkContext.broadcast(start)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        floor, kept, held = shared.value.copy(), [], 0
        for batch in batches:
            bound = bounds(batch)
            for row in range(batch.num_rows):
                # Floors rise while a batch is read.
                chosen = np.flatnonzero((bound[row] >= floor) & (bound[row] > -np.inf))
                if not len(chosen):
                    continue
                query, ids, score = scores(batch, row, chosen, floor)
                good = score >= floor[query]
                kept.append((query[good], score[good], ids[good]))
                held += int(good.sum())
                if held > 2 * k * count:
                    kept = _merge(kept, floor, k)
                    held = sum(len(part[0]) for part in kept)
        for query, score, ids in _merge(kept, floor, k):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(query)), pa.array(ids), pa.array(score)], names=schema.names)

    return blocks.mapInArrow(scan, schema)


def _ids(batch, row: int, at: int = 1):
    ids = batch.column(at)[row].values.to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids


def bounded_dense_topk(
    queries: DataFrame, blocks: DataFrame, k: int = 100,
    broadcast_bytes: int = BROADCAST_BYTES, first_blocks: int = FIRST_BLOCKS,
) -> DataFrame:
    """The hits of ``dense_topk``, from ``dense_blocks`` of the documents.

    A document's product with a query is at most the centroid's plus the
    query's length times the radius.
    """
    import numpy as np

    queries = queries.select("qid", "vec").where("vec is not null")
    kinds = blocks.schema
    schema = T.StructType().add("qid", queries.schema["qid"].dataType)
    schema = schema.add("docid", kinds["docids"].dataType.elementType).add("score", T.DoubleType())
    blocks = _in_few_tasks(blocks.select("block", "docids", "centroid", "radius", "vecs"), None)
    size = blocks.select(F.max(F.size("docids"))).first()[0] or 1
    first_blocks = max(first_blocks, -(-k // size))

    def one(part: DataFrame) -> DataFrame:
        table = part.toArrow().combine_chunks()
        if not table.num_rows:
            return part.sparkSession.createDataFrame([], schema)
        qids, matrix = table.column("qid").combine_chunks(), as_matrix(table.column("vec").chunk(0))
        shared = part.sparkSession.sparkContext.broadcast((matrix, np.sqrt((matrix * matrix).sum(axis=1))))

        def bounds(batch):
            matrix, lengths = shared.value
            at = batch.schema.get_field_index("centroid")
            centres, radius = as_matrix(batch.column(at), width=matrix.shape[1]), batch.column(at + 1).to_numpy()
            bound = centres @ matrix.T + radius[:, None] * lengths[None, :]
            # More than the rounding of either product.
            reach = np.sqrt((centres * centres).sum(axis=1)) + radius
            return bound + 1e-12 * (1 + reach[:, None] * lengths[None, :])

        def scores(batch, row, chosen, floor):
            matrix, lengths = shared.value
            ids, rows = _ids(batch, row), batch.column(4)[row].values.to_numpy().reshape(-1, matrix.shape[1])
            if floor is None:
                query, doc = np.repeat(chosen, len(ids)), np.tile(np.arange(len(ids)), len(chosen))
            else:
                reach = np.sqrt((rows * rows).sum(axis=1).max())
                margin = 8 * rows.shape[1] * np.finfo(np.float64).eps * reach * lengths[chosen]
                near, doc = np.nonzero(matrix[chosen] @ rows.T >= (floor[chosen] - margin)[:, None])
                query = chosen[near]
            # Scored in a fixed order, whatever else is in the block.
            score, step = np.empty(len(query)), max(1, ENTRIES // matrix.shape[1])
            for low in range(0, len(query), step):
                part = slice(low, low + step)
                score[part] = (matrix[query[part]] * rows[doc[part]]).sum(axis=1)
            return query, ids[doc], score

        return _search(qids, blocks, ["centroid", "radius"], bounds, scores, k, schema, first_blocks)

    return top_k(reduce(DataFrame.unionByName, map(one, _blocks(queries, broadcast_bytes, k))), k)


def dense_work(queries: DataFrame, blocks: DataFrame, k: int = 100) -> float:
    """The share of pairs of query and block whose bound reaches the query's k-th best score.

    No search by these bounds can multiply fewer.
    """
    worst = bounded_dense_topk(queries, blocks, k).groupBy("qid").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    floors = queries.join(worst, "qid").select("vec", F.when(F.col("n") == k, F.col("floor")).alias("floor"))
    held = floors.toArrow().combine_chunks()
    matrix = as_matrix(held.column("vec").chunk(0))
    floor = held.column("floor").fill_null(float("-inf")).to_numpy()
    shared = blocks.sparkSession.sparkContext.broadcast((matrix, floor))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        matrix, floor = shared.value
        for batch in batches:
            bound = as_matrix(batch.column(0)) @ matrix.T
            bound = bound + batch.column(1).to_numpy()[:, None] * np.sqrt((matrix * matrix).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([int((bound >= floor).sum())]), pa.array([bound.size])], names=["reached", "pairs"])

    sums = blocks.select("centroid", "radius").mapInArrow(run, "reached long, pairs long")
    return sums.agg(F.sum("reached") / F.sum("pairs")).first()[0]


def bounded_sparse_topk(
    query_terms: DataFrame, blocks: DataFrame, k: int = 100,
    broadcast_bytes: int = BROADCAST_BYTES, first_blocks: int = FIRST_BLOCKS,
) -> DataFrame:
    """The hits of ``sparse_topk``, from ``sparse_blocks`` of the index.

    A term adds at most its weight in the query times the block's largest or
    smallest weight of it, or nothing.
    """
    import numpy as np

    weight = F.col("weight").cast("double").alias("weight")
    queries = query_terms.select("qid", "term", weight).where("term is not null and weight is not null")
    schema = T.StructType().add("qid", queries.schema["qid"].dataType)
    schema = schema.add("docid", blocks.schema["docids"].dataType.elementType).add("score", T.DoubleType())
    names = ["block", "docids", "sizes", "terms", "weights", "bound_terms", "highs", "lows"]
    blocks = _in_few_tasks(blocks.select(*names), None)
    size = blocks.select(F.max(F.size("docids"))).first()[0] or 1
    first_blocks = max(first_blocks, -(-k // size))

    def one(part: DataFrame) -> DataFrame:
        table = part.toArrow().combine_chunks().sort_by("term")
        if not table.num_rows:
            return part.sparkSession.createDataFrame([], schema)
        qids = table.column("qid").unique()
        place = {qid: i for i, qid in enumerate(qids.to_pylist())}
        query = np.array([place[qid] for qid in table.column("qid").to_pylist()])
        terms = table.column("term").value_counts().flatten()
        first = np.concatenate([[0], np.cumsum(terms[1].to_numpy())])
        shared = part.sparkSession.sparkContext.broadcast((terms[0], first, query, table.column("weight").to_numpy(), len(qids)))

        def matched(column):
            """The known terms of a list column: entry, and where the queries of its term begin and end."""
            import pyarrow.compute as pc

            terms, first, *_ = shared.value
            found = pc.index_in(column, value_set=terms)
            entry = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            term = found.to_numpy(zero_copy_only=False)[entry].astype(np.int64)
            return entry, first[term], first[term + 1] - first[term]

        def spread(starts, sizes):
            """Which match and which query entry, for each query entry of each match."""
            each = np.repeat(np.arange(len(starts)), sizes)
            return each, np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)

        def bounds(batch):
            _, _, query, weights, count = shared.value
            at = batch.schema.get_field_index("bound_terms")
            entry, starts, sizes = matched(batch.column(at).flatten())
            row = np.repeat(np.arange(batch.num_rows), batch.column(at).value_lengths().to_numpy())[entry]
            high, low = (batch.column(at + i).flatten().to_numpy()[entry] for i in (1, 2))
            each, of = spread(starts, sizes)
            most = np.maximum(np.maximum(weights[of] * high[each], weights[of] * low[each]), 0.0)
            cell = row[each] * count + query[of]
            bound = np.bincount(cell, most, minlength=batch.num_rows * count).reshape(-1, count)
            # Without a common term a document is no hit; sums may differ in their last bits.
            seen = np.bincount(cell, minlength=batch.num_rows * count).reshape(-1, count) > 0
            return np.where(seen, bound * (1 + 1e-12) + 1e-300, -np.inf)

        def scores(batch, row, chosen, floor):
            _, _, query, weights, count = shared.value
            ids, sizes = _ids(batch, row), batch.column(2)[row].values.to_numpy()
            entry, starts, fan = matched(batch.column(3)[row].values)
            weight = batch.column(4)[row].values.to_numpy()[entry]
            doc = np.repeat(np.arange(len(ids)), sizes)[entry]
            each, of = spread(starts, fan)
            wanted = np.full(count, -1)
            wanted[chosen] = np.arange(len(chosen))
            mine = wanted[query[of]] >= 0
            each, of = each[mine], of[mine]
            cell = wanted[query[of]] * len(ids) + doc[each]
            total = np.bincount(cell, weight[each] * weights[of], minlength=len(chosen) * len(ids))
            found = np.unique(cell)
            return chosen[found // len(ids)], ids[found % len(ids)], total[found]

        return _search(qids, blocks, ["bound_terms", "highs", "lows"], bounds, scores, k, schema, first_blocks)

    return top_k(reduce(DataFrame.unionByName, map(one, _blocks(queries, broadcast_bytes, k))), k)
