"""First-stage retrieval: exact dense and sparse top-k per query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxrank.functions.vectors import as_matrix
from ctxrank.operators.ranking import top_k
from ctxrank.session import BROADCAST_BYTES, matching, row_bytes, stage, table_bytes

# Hits of a block of queries, of which each task may hold twice as many.
HITS = 1_000_000


def judged(topics: DataFrame, qrels: DataFrame) -> DataFrame:
    """The topics that have judgements."""
    return topics.join(qrels.select("qid").distinct(), "qid", "left_semi")


def _merge(kept: list, floor, k: int) -> list:
    """The k best of each query among parts of (query, score, document), ties by document.

    Raises ``floor``, the k-th best score per query, in place.
    """
    import numpy as np

    if not kept:
        return []
    col, score, doc = (np.concatenate(parts) for parts in zip(*kept))
    counts = np.bincount(col, minlength=len(floor))
    lowest = np.full(len(floor), np.inf)
    np.minimum.at(lowest, col, score)
    floor[counts == k] = lowest[counts == k]
    full = counts[col] > k
    done = [(col[~full], score[~full], doc[~full])]
    col, score, doc = col[full], score[full], doc[full]
    if len(col):
        order = np.lexsort((doc, -score, col))
        col, score, doc = col[order], score[order], doc[order]
        place = np.arange(len(col)) - np.searchsorted(col, np.arange(len(floor)))[col]
        floor[col[place == k - 1]] = score[place == k - 1]
        best = place < k
        done.append((col[best], score[best], doc[best]))
    return done


def _running_top_k(k: int, entries: int = 4_000_000, tile: int = 1024, sorted_hits: int = 250_000) -> Callable:
    """Kernel: the k best documents per query over Arrow batches.

    Queries and documents are multiplied in blocks of ``tile`` queries, fewer where these have
    more than ``sorted_hits`` hits to sort at once, and about ``entries`` products. What passes a query's floor, its k-th best so far with a
    margin for the product's rounding, is scored again in a fixed order, so a
    document's score does not depend on the batch it came in, and put in the block's
    buffer. Only a buffer larger than the block's best is merged into them, so the
    best are not sorted at every step. Returns parts of (query, score, document).
    """
    import numpy as np

    def rescore(queries, docs, cols, rows, step=2048):
        scores = np.empty(len(rows))
        for i in range(0, len(rows), step):
            part = slice(i, i + step)
            scores[part] = (queries[cols[part]] * docs[rows[part]]).sum(axis=1)
        return scores

    def hopeful(product, floor, margin):
        """The products that may be among the k best, as queries and rows."""
        chosen = product >= (floor - margin)[:, None]
        rows = product.shape[1]
        if rows > k and np.count_nonzero(chosen) > 2 * k * len(product):
            kth = np.partition(product, rows - k, axis=1)[:, rows - k]
            chosen &= product >= (kth - margin)[:, None]
        return np.nonzero(chosen)

    tile = min(tile, max(sorted_hits // k, 32))

    def search(queries, batches):
        tiles = [slice(i, i + tile) for i in range(0, len(queries), tile)]
        lengths = np.sqrt((queries * queries).sum(axis=1))
        step = max(entries // max(min(tile, len(queries)), 1), 1)
        floors = np.full(len(queries), -np.inf)
        kept = [[] for _ in tiles]
        held = [0 for _ in tiles]
        for all_ids, all_docs in batches:
            if all_ids.dtype == object:
                all_ids = all_ids.astype(str)
            for start in range(0, len(all_ids), step):
                docs, ids = all_docs[start : start + step], all_ids[start : start + step]
                reach = np.sqrt((docs * docs).sum(axis=1).max())
                margins = 8 * docs.shape[1] * np.finfo(np.float64).eps * reach * lengths
                for i, part in enumerate(tiles):
                    floor = floors[part]
                    col, row = hopeful(queries[part] @ docs.T, floor, margins[part])
                    if not len(col):
                        continue
                    kept[i].append((col, rescore(queries[part], docs, col, row), ids[row]))
                    held[i] += len(col)
                    # The first block sets the floors; later ones wait in the buffer.
                    if held[i] > 2 * k * len(floor) or np.isneginf(floor).any():
                        kept[i] = _merge(kept[i], floor, k)
                        held[i] = sum(len(part_kept[0]) for part_kept in kept[i])
        for i, part in enumerate(tiles):
            for col, score, doc in _merge(kept[i], floors[part], k):
                if len(col):
                    yield col + part.start, score, doc

    return search


def _hit_schema(queries: DataFrame, docs: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("docid", docs.schema["docid"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def dense_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 100,
    broadcast_bytes: int = BROADCAST_BYTES,
    scan_tasks: int | None = None,
) -> DataFrame:
    """The k documents with the largest dot product, per query.

    ``queries(qid, vec)``, ``docs(docid, vec)`` -> ``(qid, docid, score, rank)``,
    ties by docid. Queries of up to ``broadcast_bytes`` go to every task, in blocks with
    a bounded number of hits and one scan of the documents a block; each task passes on only its own
    k best per query, so the documents are scanned in place and never shuffled.
    Larger query sides are not sent through the driver: pieces of both sides meet in cogroups.
    As the last shuffle holds k rows per query and task, splits are read
    together in at most ``scan_tasks`` tasks, by default four a core.
    """
    queries = queries.select("qid", "vec").where("vec is not null")
    docs = docs.select("docid", "vec").where("vec is not null")
    if table_bytes(queries) > broadcast_bytes:
        return top_k(_cogrouped_search(queries, docs, k), k)
    docs = _in_few_tasks(docs, scan_tasks)
    scans = [_scan_search(block, docs, k) for block in _blocks(queries, broadcast_bytes, k)]
    return top_k(reduce(DataFrame.unionByName, scans), k)


def _cogrouped_search(
    queries: DataFrame, docs: DataFrame, k: int, piece_bytes: int = 16 << 20, hits: int = HITS
) -> DataFrame:
    """The k best of every piece of the documents, per query, for query sides too large to broadcast.

    Both sides are cut into pieces of about ``piece_bytes``, those of the queries with at most about
    ``hits`` hits as well; every piece of the one meets every piece of the other in a cogroup.
    """
    schema, parallel = _hit_schema(queries, docs), docs.sparkSession.sparkContext.defaultParallelism
    size, n = queries.agg(F.sum(row_bytes(queries)), F.count_distinct("qid")).first()
    pieces = max(1, -(-(size or 0) // piece_bytes), -(-n * k // hits))
    parts = max(-(-parallel // pieces), -(-table_bytes(docs) // piece_bytes))
    search = _running_top_k(k)

    def dealt(side: DataFrame, own: str, count: int, other: str, copies: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(*side.columns), F.lit(count)).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other)
        return side.select("*", mine, each)

    def best(left, right):
        import numpy as np
        import pyarrow as pa

        left, right = left.combine_chunks(), right.combine_chunks()
        found = []
        if left.num_rows and right.num_rows:
            qids, matrix = left.column("qid").chunk(0), as_matrix(left.column("vec").chunk(0))
            rows = as_matrix(right.column("vec").chunk(0), width=matrix.shape[1])
            ids = right.column("docid").to_numpy()
            for col, score, docids in search(matrix, [(ids, rows)]):
                found.append(pa.table([qids.take(pa.array(col)), pa.array(docids), pa.array(score)], names=schema.names))
        empty = pa.table([left.column("qid").slice(0, 0), right.column("docid").slice(0, 0), pa.array(np.empty(0))], names=schema.names)
        return pa.concat_tables(found) if found else empty

    left = dealt(queries, "_piece", pieces, "_part", parts).groupBy("_piece", "_part")
    right = dealt(docs, "_part", parts, "_piece", pieces).groupBy("_piece", "_part")
    return left.cogroup(right).applyInArrow(best, schema)


def _in_few_tasks(docs: DataFrame, tasks: int | None) -> DataFrame:
    if tasks is None:
        spark = docs.sparkSession
        cores = spark.sparkContext.defaultParallelism
        tasks = max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.coalesce(tasks)


def _blocks(queries: DataFrame, bytes_each: int, k: int, entries: int = HITS) -> list[DataFrame]:
    """The queries in blocks of about ``bytes_each``, and of at most about ``entries`` hits."""
    size, n = queries.agg(F.sum(row_bytes(queries)), F.count_distinct("qid")).first()
    blocks = max(1, -(-(size or 0) // max(bytes_each, 1)), -(-n * k // entries))
    if blocks == 1:
        return [queries]
    block, queries = F.pmod(F.xxhash64("qid"), F.lit(blocks)), stage(queries)
    return [queries.where(block == i) for i in range(blocks)]


def _scan_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    table = queries.toArrow().combine_chunks()
    if not table.num_rows:
        return docs.sparkSession.createDataFrame([], _hit_schema(queries, docs))
    vectors = as_matrix(table.column("vec").chunk(0))
    shared = docs.sparkSession.sparkContext.broadcast((table.column("qid"), vectors))
    search = _running_top_k(k)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        qids, queries = shared.value
        parts = (
            (b.column(0).to_numpy(zero_copy_only=False), as_matrix(b.column(1), width=queries.shape[1]))
            for b in batches
            if b.num_rows
        )
        for col, score, ids in search(queries, parts):
            columns = [qids.take(pa.array(col)).combine_chunks(), pa.array(ids), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "docid", "score"])

    return docs.mapInArrow(scan, _hit_schema(queries, docs))


def frequent_enough(
    query_terms: DataFrame, postings: DataFrame, documents: int, min_idf: float
) -> DataFrame:
    """Query terms whose idf, ln(documents / document frequency), is at least ``min_idf``."""
    rare = (
        matching(postings, query_terms, "term")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .where(F.log(F.lit(float(documents)) / F.col("df")) >= min_idf)
    )
    return query_terms.join(rare.select("term"), "term", "left_semi")


def term_index(postings: DataFrame) -> DataFrame:
    """``(docid, terms, weights)``: the postings of a document as one row of arrays."""
    entry = F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight")))
    rows = postings.where("weight is not null").groupBy("docid").agg(entry.alias("entries"))
    return rows.select("docid", F.col("entries.term").alias("terms"), F.col("entries.weight").alias("weights"))


def sparse_topk(
    query_terms: DataFrame,
    postings: DataFrame,
    k: int = 100,
    min_idf: float = 0.0,
    documents: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    scan_tasks: int | None = None,
) -> DataFrame:
    """The k documents with the largest sum of weight products over shared terms.

    ``query_terms(qid, term, weight)`` and a ``term_index`` of the documents ->
    ``(qid, docid, score, rank)``. Blocks of queries of about ``broadcast_bytes``
    go to every task, one scan of the index a block: it is never shuffled, no
    row is made for a pair, and each task passes on its own k best per query.
    Postings ``(docid, term, weight)``, one row per document and term, are
    accepted as well; those of query terms are then first gathered by document and staged, as a
    task of the scan reads several splits and would hold the sums of each.
    Rows without a weight take no part. ``min_idf`` above 0 needs the number of
    ``documents``; an idf is never below 0, so the default keeps every term.
    """
    gathered = "terms" in postings.columns
    if min_idf > 0:
        if documents is None:
            raise ValueError("min_idf needs the number of documents")
        each = postings.select("docid", F.explode("terms").alias("term")) if gathered else postings
        query_terms = frequent_enough(query_terms, each, documents, min_idf)
    weight = F.col("weight").cast("double").alias("weight")
    queries = query_terms.select("qid", "term", weight).where("term is not null and weight is not null")
    if not gathered:
        postings = stage(term_index(matching(postings, queries, "term", broadcast_bytes)))
    index = _in_few_tasks(postings.select("docid", "terms", "weights"), scan_tasks)
    scans = [_scan_terms(block, index, k) for block in _blocks(queries, broadcast_bytes, k)]
    return top_k(reduce(DataFrame.unionByName, scans), k)


def _scan_terms(
    queries: DataFrame, index: DataFrame, k: int, entries: int = 1_000_000, rows: int = 1024
) -> DataFrame:
    import numpy as np

    schema = _hit_schema(queries, index)
    table = queries.toArrow().combine_chunks().sort_by("term")
    if not table.num_rows:
        return index.sparkSession.createDataFrame([], schema)
    qids = table.column("qid").unique()
    place = {qid: i for i, qid in enumerate(qids.to_pylist())}
    query = np.array([place[qid] for qid in table.column("qid").to_pylist()])
    terms = table.column("term").value_counts().flatten()
    first = np.concatenate([[0], np.cumsum(terms[1].to_numpy())]) if len(terms) else np.zeros(1, int)
    weights = table.column("weight").to_numpy()
    shared = index.sparkSession.sparkContext.broadcast((qids, terms[0], first, query, weights))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        qids, terms, first, query, weights = shared.value
        count = len(qids)
        floor, kept, held = np.full(count, -np.inf), [], 0
        # Arrow cuts batches by rows; a few documents at once keep the arrays below small.
        parts = (batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))
        for batch in parts:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            found = pc.index_in(batch.column(1).flatten(), value_set=terms)
            known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            term = found.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            doc = np.repeat(np.arange(len(ids)), lengths)[known]
            weight = batch.column(2).flatten().to_numpy(zero_copy_only=False)[known]
            fan = first[term + 1] - first[term]
            # A step is a run of documents with a bounded number of products.
            made = np.concatenate([[0], np.cumsum(np.bincount(doc, fan, minlength=len(ids)))])
            most, low = max(entries // count, 1), 0
            while low < len(ids):
                high = int(np.searchsorted(made, made[low] + entries, "right")) - 1
                high = min(max(high, low + 1), low + most, len(ids))
                mine = slice(*np.searchsorted(doc, [low, high]))
                each = np.repeat(np.arange(mine.start, mine.stop), fan[mine])
                ends = np.cumsum(fan[mine])
                at = first[term[each]] + np.arange(len(each)) - (ends - fan[mine])[each - mine.start]
                cell = query[at] * (high - low) + doc[each] - low
                size = count * (high - low)
                scores = np.bincount(cell, weight[each] * weights[at], minlength=size)
                chosen = np.bincount(cell, minlength=size) > 0
                chosen &= scores >= np.repeat(floor, high - low)
                cells = np.flatnonzero(chosen)
                if len(cells):
                    col = cells // (high - low)
                    kept.append((col, scores[cells], ids[low + cells % (high - low)]))
                    held += len(cells)
                # ``_blocks`` bounds the hits of a block's queries.
                if held > max(2 * k * count, 100_000):
                    kept = _merge(kept, floor, k)
                    held = sum(len(part[0]) for part in kept)
                low = high
        for col, score, docs in _merge(kept, floor, k):
            columns = [qids.take(pa.array(col)), pa.array(docs), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "docid", "score"])

    return index.mapInArrow(scan, schema)
