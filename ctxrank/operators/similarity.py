"""Similarity of candidate pairs: a query's vector and the vectors of a document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxrank.functions.vectors import as_matrix
from ctxrank.session import BROADCAST_BYTES, broadcast_within, matching, stage, table_bytes

# Bytes of vectors and products in a block, and vectors or queries of a document in a piece.
BLOCK_BYTES = 64 << 20
PIECE = 512
# Products of a task of all pairs, and queries of a run of its result.
TASK_PRODUCTS = 1 << 26
RUN = 1024
METHODS = (None, "cos")


def similarities(
    pairs: DataFrame,
    query_vecs: DataFrame,
    vectors: DataFrame,
    items: tuple[str, ...] = (),
    method: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block: int = PIECE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``sim`` of every pair and vector of its document.

    Distinct ``pairs(qid, docid)``, ``query_vecs(qid, vec)`` and ``vectors(docid,
    vec)`` with the item columns -> ``(qid, docid, *items, sim)``; a dot product, or
    the cosine for ``"cos"``. Pairs and query vectors that fit are broadcast:
    the vectors are filtered and multiplied where they are scanned, each
    crossing to Python once however many queries share its document. Larger
    sides are multiplied in cogrouped blocks. Both add a product's terms in the same
    order, so they give the same numbers.
    """
    pairs = pairs.select("qid", "docid")
    queries = query_vecs.select("qid", "vec")
    vectors = vectors.where("vec is not null")
    if max(table_bytes(pairs), table_bytes(queries)) <= broadcast_bytes:
        return _scan(pairs, queries, vectors, items, method)
    return _join(pairs, queries, vectors, items, method, block, block_bytes)


def _scan(
    pairs: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    items: tuple[str, ...],
    method: str | None,
    entries: int = 4_000_000,
) -> DataFrame:
    import numpy as np

    wanted = matching(vectors, pairs, "docid").select("docid", *items, "vec")
    schema = _sim_schema(queries, wanted.drop("vec"))
    table = queries.toArrow().combine_chunks()
    place = {qid: i for i, qid in enumerate(table.column("qid").to_pylist())}
    known = pairs.toPandas()
    known = known[known["qid"].isin(place)].sort_values("docid", kind="stable")
    if not len(known):
        return vectors.sparkSession.createDataFrame([], schema)
    unit = method == "cos"
    matrix = as_matrix(table.column("vec").chunk(0), unit)
    docids = known["docid"].to_numpy()
    docids = docids.astype(str) if docids.dtype == object else docids
    query_of_pair = known["qid"].map(place).to_numpy()
    shared = vectors.sparkSession.sparkContext.broadcast(
        (docids, query_of_pair, table.column("qid").chunk(0), matrix)
    )

    def multiply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        docids, query_of_pair, qids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = _ids(batch.column("docid"))
            values = as_matrix(batch.column("vec"), unit, matrix.shape[1])
            first = np.searchsorted(docids, ids, "left")
            counts = np.searchsorted(docids, ids, "right") - first
            ends = np.cumsum(counts)
            step = max(entries // matrix.shape[1], 1)
            for start in range(0, int(ends[-1]), step):
                flat = np.arange(start, min(start + step, int(ends[-1])))
                row = np.searchsorted(ends, flat, "right")
                query = query_of_pair[first[row] + flat - (ends[row] - counts[row])]
                sim = (values[row] * matrix[query]).sum(axis=1)
                taken = batch.drop_columns(["vec"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [qids.take(pa.array(query)), *taken.columns, pa.array(sim, from_pandas=True)],
                    names=schema.names,
                )

    return wanted.mapInArrow(multiply, schema)


def _join(
    pairs: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    items: tuple[str, ...],
    method: str | None,
    piece: int,
    block_bytes: int,
) -> DataFrame:
    """Multiply cogrouped blocks of document and query vectors, for sides too large to broadcast.

    A document's vectors and its queries are dealt into pieces of about ``piece`` each, and
    every pair of pieces into one of as many blocks as the bytes of both sides and of
    the results ask for. So a document with very many vectors or queries is spread over
    blocks, small ones share them, and a query's vector crosses once to each block that
    has one of its documents.
    """
    spark = vectors.sparkSession
    pairs = stage(pairs.join(queries.select("qid"), "qid", "left_semi"))
    wanted = vectors.join(pairs.select("docid").distinct(), "docid", "left_semi")
    dims = queries.select(F.size("vec").alias("n")).agg(F.max("n")).first()[0] or 1
    counts = (
        wanted.groupBy("docid").agg(F.count("*").alias("n_vec"))
        .join(pairs.groupBy("docid").agg(F.count("*").alias("n_qid")), "docid")
    )
    counts = stage(
        counts.withColumn("v_parts", F.ceil(F.col("n_vec") / piece)).withColumn("q_parts", F.ceil(F.col("n_qid") / piece))
    )
    # Each piece crosses once for each piece of the other side.
    crossing = F.col("n_vec") * F.col("q_parts") + F.col("n_qid") * F.col("v_parts")
    size = F.sum(crossing * (8 * dims + 32) + F.col("n_vec") * F.col("n_qid") * 32)
    blocks = max(1, -(-int(counts.agg(size).first()[0] or 0) // block_bytes))
    large = counts.where("v_parts > 1 or q_parts > 1").select("docid", "v_parts", "q_parts")
    large = stage(large)
    large = broadcast_within(large) or large

    def dealt(side: DataFrame, own: str, other: str, spread: Column) -> DataFrame:
        """``side`` with its own piece, a copy for each piece of the other side, and their block."""
        parts = side.join(large, "docid", "left")
        mine = F.coalesce(F.pmod(spread, F.col(f"{own}_parts")), F.lit(0))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(f"{other}_parts"), F.lit(1)) - 1))
        parts = parts.withColumn(f"_{own}", mine.cast("long")).withColumn(f"_{other}", each)
        block = F.pmod(F.xxhash64("docid", "_v", "_q"), F.lit(blocks)).cast("int")
        return parts.withColumn("_block", block).drop("v_parts", "q_parts")

    left = dealt(wanted.select("docid", *items, "vec"), "v", "q", F.xxhash64("docid", *items))
    left = left.select("_block", "docid", "_v", "_q", *items, "vec")
    cells = dealt(pairs, "q", "v", F.xxhash64("qid"))
    right = cells.groupBy("_block", "qid").agg(F.collect_list(F.struct("docid", "_v", "_q")).alias("cells"))
    right = right.join(queries, "qid").select("_block", "qid", "cells", "vec")
    schema = _sim_schema(queries, left.select("docid", *items))
    kernel = _multiply_block(schema, items, method == "cos")
    return left.groupBy("_block").cogroup(right.groupBy("_block")).applyInArrow(kernel, schema)


def _multiply_block(schema: T.StructType, items: tuple[str, ...], unit: bool, entries: int = 4_000_000):
    """Cogroup step: the products of a block's vectors with the queries of their document."""

    def multiply(left, right):
        import numpy as np
        import pyarrow as pa

        def codes(docid, v, q, known):
            place = np.searchsorted(known, _ids(docid))
            return place, v.to_numpy(), q.to_numpy()

        right, left = right.combine_chunks(), left.combine_chunks()
        empty = pa.Table.from_batches([], schema=_arrow_schema(schema))
        if not right.num_rows or not left.num_rows:
            return empty
        lists = right.column("cells").chunk(0)
        cells = lists.flatten()
        owner = np.repeat(np.arange(right.num_rows), lists.value_lengths().to_numpy())
        asked = [cells.field(f) for f in ("docid", "_v", "_q")]
        held = [left.column(f).chunk(0) for f in ("docid", "_v", "_q")]
        known = np.unique(np.concatenate([_ids(asked[0]), _ids(held[0])]))
        asked, held = np.stack(codes(*asked, known)), np.stack(codes(*held, known))
        both = np.unique(np.concatenate([asked, held], axis=1), axis=1, return_inverse=True)[1].ravel()
        asked, held = both[: asked.shape[1]], both[asked.shape[1] :]
        order = np.argsort(asked, kind="stable")
        asked, owner = asked[order], owner[order]
        matrix = as_matrix(right.column("vec").chunk(0), unit)
        values = as_matrix(left.column("vec").chunk(0), unit, matrix.shape[1])
        first = np.searchsorted(asked, held, "left")
        sizes = np.searchsorted(asked, held, "right") - first
        ends = np.cumsum(sizes)
        step = max(entries // max(matrix.shape[1], 1), 1)
        rows, queries, sims = [], [], []
        for start in range(0, int(ends[-1]), step):
            flat = np.arange(start, min(start + step, int(ends[-1])))
            row = np.searchsorted(ends, flat, "right")
            query = owner[first[row] + flat - (ends[row] - sizes[row])]
            rows.append(row)
            queries.append(query)
            sims.append((values[row] * matrix[query]).sum(axis=1))
        if not rows:
            return empty
        row, query, sim = (np.concatenate(x) for x in (rows, queries, sims))
        taken = left.select(["docid", *items]).take(pa.array(row)).columns
        qid = right.column("qid").take(pa.array(query))
        return pa.Table.from_arrays([qid, *taken, pa.array(sim, from_pandas=True)], names=schema.names)

    return multiply


def every_similarity(
    query_vecs: DataFrame,
    vectors: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Best and mean product of every query with the vectors of every document.

    ``query_vecs(qid, vec)`` and ``vectors(docid, vec)`` -> ``(qid, docid, max_sim, mean_sim,
    questions)``, the last the number of products. The vectors are dealt out by document and sorted once;
    blocks of queries of about ``broadcast_bytes`` go to every task, which holds no more
    than a bounded number of products and the sums of one document. Rows of one query
    count together, and so do those of one document. The result grows with the product of both sides, and so
    does the number of tasks; its rows come in short runs of queries, so that their ids compress.
    """
    queries = query_vecs.select("qid", "vec").where("qid is not null and vec is not null")
    vectors = vectors.select("docid", "vec").where("docid is not null and vec is not null")
    vectors = stage(vectors)
    blocks = max(1, -(-table_bytes(queries) // broadcast_bytes))
    # As many tasks as bytes and products ask for, each with whole documents.
    products = vectors.count() * -(-queries.count() // blocks)
    wanted = max(-(-table_bytes(vectors) // BLOCK_BYTES), -(-products // TASK_PRODUCTS))
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, wanted)
    vectors = vectors.repartition(parts, "docid").sortWithinPartitions("docid")
    if blocks == 1:
        return _every_block(queries, vectors)
    block, queries = F.pmod(F.xxhash64("qid"), F.lit(blocks)), stage(queries)
    return reduce(DataFrame.unionByName, [_every_block(queries.where(block == i), vectors) for i in range(blocks)])


def _every_block(queries: DataFrame, vectors: DataFrame, entries: int = 1_000_000) -> DataFrame:
    import numpy as np

    schema = T.StructType([queries.schema["qid"], vectors.schema["docid"]])
    schema = schema.add("max_sim", T.DoubleType()).add("mean_sim", T.DoubleType()).add("questions", T.LongType())
    table = queries.toArrow().combine_chunks()
    if not table.num_rows:
        return vectors.sparkSession.createDataFrame([], schema)
    table = table.sort_by("qid").combine_chunks()
    codes = table.column("qid").combine_chunks().dictionary_encode()
    # Where the rows of each query begin.
    begin = np.unique(codes.indices.to_numpy(), return_index=True)[1]
    shared = vectors.sparkSession.sparkContext.broadcast(
        (codes.dictionary, begin, len(codes), as_matrix(table.column("vec").chunk(0)))
    )

    def multiply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        qids, begin, copies, matrix = shared.value
        ends = np.append(begin, copies)
        copies = np.diff(ends)
        runs = [slice(low, min(low + RUN, len(qids))) for low in range(0, len(qids), RUN)]
        step = max(entries // max(ends[run.stop] - ends[run.start] for run in runs), 1)

        def rows(run, docids, best, total, count):
            count = count[:, None] * copies[None, run]
            each = pa.array(np.tile(np.arange(run.start, run.stop), len(docids)))
            columns = [qids.take(each), docids.take(pa.array(np.repeat(np.arange(len(docids)), run.stop - run.start)))]
            columns += [pa.array(best.ravel()), pa.array((total / count).ravel()), pa.array(count.ravel())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        held = None
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                docids, values = part.column(0), as_matrix(part.column(1), width=matrix.shape[1])
                codes = docids.dictionary_encode().indices.to_numpy()
                start = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
                count = np.diff(np.append(start, len(codes)))
                docids = docids.take(pa.array(start))
                # The last document may go on in the next part.
                same = held is not None and held[0][0] == docids[0]
                if same:
                    count[0] += held[3][0]
                elif held is not None:
                    yield rows(slice(0, len(qids)), *held)
                last = np.empty((2, 1, len(qids)))
                for run in runs:
                    product = values @ matrix[ends[run.start] : ends[run.stop]].T
                    first = begin[run] - begin[run.start]
                    best = np.maximum.reduceat(np.maximum.reduceat(product, start, axis=0), first, axis=1)
                    total = np.add.reduceat(np.add.reduceat(product, start, axis=0), first, axis=1)
                    if same:
                        best[0], total[0] = np.maximum(best[0], held[1][0, run]), total[0] + held[2][0, run]
                    if len(docids) > 1:
                        yield rows(run, docids[:-1], best[:-1], total[:-1], count[:-1])
                    last[0, 0, run], last[1, 0, run] = best[-1], total[-1]
                held = docids[-1:], last[0], last[1], count[-1:]
        if held is not None:
            yield rows(slice(0, len(qids)), *held)

    return vectors.mapInArrow(multiply, schema)


def _ids(column):
    """Ids of an Arrow column as NumPy values that sort."""
    ids = column.to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids


def _arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _sim_schema(queries: DataFrame, rows: DataFrame) -> T.StructType:
    """qid, the fields of ``rows`` and sim."""
    return T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            *rows.schema.fields,
            T.StructField("sim", T.DoubleType()),
        ]
    )
