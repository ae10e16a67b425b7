"""Hypothetical questions: from documents to parsed questions and their vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxrank.functions.prompts import build_prompt
from ctxrank.functions.text import (
    NO_CONTENT,
    cut_completion,
    document_text,
    is_empty_passage,
    parse_passages,
    parse_questions,
    word_windows,
)
from ctxrank.functions.vectors import as_matrix, text_key
from ctxrank.operators.ranking import rank_all
from ctxrank.operators.rerank import SPREAD_COEF, question_score
from ctxrank.operators.similarity import similarities
from ctxrank.session import broadcast_within, matching, stage

DRAWS = 10


def prompts(
    docs: DataFrame, task: str | None, wrapper: str | None = None, text: str = "context"
) -> DataFrame:
    """Prompt and prompt key of each document; whether it needs no model."""
    filled = docs.withColumn("prompt", build_prompt(F.col(text), task, wrapper))
    return filled.withColumns(
        {"prompt_key": text_key(F.col("prompt")), "empty": is_empty_passage(F.col("prompt"))}
    )


def contexts(docids: DataFrame, corpus: DataFrame) -> DataFrame:
    """Text of the wanted documents; one that the corpus lacks has the text ``''``."""
    wanted = docids.select("docid").distinct()
    found = matching(corpus.select("docid", "raw"), wanted, "docid")
    return wanted.join(found, "docid", "left").select(
        "docid", document_text(F.col("raw")).alias("context")
    )


def distinct_prompts(prompts: DataFrame) -> DataFrame:
    """The prompts to send to a model: each once, without the empty passages."""
    return prompts.where(~F.col("empty")).select("prompt_key", "prompt").distinct()


def _in_order(completions: DataFrame, parse: Callable[[Column], Column], item: str) -> DataFrame:
    """The items of each completion; positions run on over a prompt's choices.

    The few completions of a prompt meet as texts and are parsed in their order,
    so no array of items is shuffled or sorted.
    """
    choices = F.array_sort(F.collect_list(F.struct("choice", "text"))).alias("_choices")
    whole = completions.where("text is not null").groupBy("prompt_key").agg(choices)
    items = F.flatten(F.transform("_choices", lambda c: parse(cut_completion(c["text"]))))
    return whole.select("prompt_key", F.posexplode(items).alias("pos", item))


def parse(completions: DataFrame, literal_strip: bool = False) -> DataFrame:
    """``completions(prompt_key, choice, text)`` -> ``(prompt_key, pos, question)``."""
    return _in_order(completions, lambda text: parse_questions(text, literal_strip), "question")


def parse_documents(completions: DataFrame) -> DataFrame:
    """``completions(prompt_key, choice, text)`` -> ``(prompt_key, pos, passage)``."""
    return _in_order(completions, parse_passages, "passage")


def whole_completions(completions: DataFrame) -> DataFrame:
    """``completions(prompt_key, choice, text)`` -> ``(prompt_key, pos, passage)``, each in one piece."""
    told = completions.where("text is not null")
    return told.select("prompt_key", F.col("choice").alias("pos"), F.col("text").alias("passage"))


def order_completions(completions: DataFrame) -> DataFrame:
    """Renumber each prompt's completions by total log-probability, best first."""
    total = F.aggregate("logprobs", F.lit(0.0), lambda s, x: s + x)
    scored = completions.withColumn("logprob", total)
    window = Window.partitionBy("prompt_key").orderBy(F.col("logprob").desc(), F.col("choice"))
    return scored.withColumn("place", F.row_number().over(window))


def document_questions(prompts: DataFrame, questions: DataFrame) -> DataFrame:
    """``(docid, pos, question)``: stored questions by prompt, and the guard's one.

    An empty passage has the single question ``no content``.
    """
    asked = prompts.where(~F.col("empty")).select("docid", "prompt_key")
    answered = asked.join(questions, "prompt_key").select("docid", "pos", "question")
    empty = prompts.where("empty").select(
        "docid", F.lit(0).alias("pos"), F.lit(NO_CONTENT).alias("question")
    )
    return answered.unionByName(empty)


def cut_no_content(questions: DataFrame, keys: tuple[str, ...] = ("docid",)) -> DataFrame:
    """Keep the questions before the first that says there is no content.

    A document with none before it keeps the single text ``no content``. The
    positions come from one aggregate that combines on the map side.
    """
    says_none = F.contains(F.lower("question"), F.lit(NO_CONTENT))
    marks = (
        questions.groupBy(*keys)
        .agg(F.min("pos").alias("_open"), F.min(F.when(says_none, F.col("pos"))).alias("_cut"))
        .where("_cut is not null")
    )
    # Where the marks fit, the questions are cut in place.
    marks = stage(marks)
    cuts = marks.drop("_open")
    cut = questions.join(broadcast_within(cuts) or cuts, [*keys], "left")
    kept = cut.where(F.col("_cut").isNull() | (F.col("pos") < F.col("_cut")))
    bare = marks.where(F.col("_cut") == F.col("_open")).select(
        *keys, F.col("_cut").alias("pos"), F.lit(NO_CONTENT).alias("question")
    )
    return kept.select(*keys, "pos", "question").unionByName(bare)


def question_vectors(
    questions: DataFrame, embeddings: DataFrame, table: DataFrame | None = None, item: str = "vec_id"
) -> DataFrame:
    """Vector of each question, looked up by its content key.

    ``embeddings(text_key, item)`` may name rows of a ``table(item, vec)`` instead of holding
    vectors; then these are not shuffled by content key, which the result lacks.
    """
    keyed = questions.withColumn("text_key", text_key(F.col("question"))).drop("question")
    if table is None:
        return keyed.join(embeddings.select("text_key", "vec"), "text_key")
    placed = keyed.join(embeddings.select("text_key", item), "text_key").drop("text_key")
    return placed.join(table.select(item, "vec"), item).drop(item)


def _draw_hash(seed: int, draw: Column, docid: Column, pos: Column) -> Column:
    return F.md5(F.concat_ws(",", F.lit(seed), draw, docid, pos).cast("binary"))


def _hash_bucket(hash_: Column) -> Column:
    return F.conv(F.substring(hash_, 1, 3), 16, 10).cast("int")


def _share(count: Column, ratio: float) -> Column:
    return F.ceil(count * F.lit(ratio))


def _bottom_of_draws(ids: DataFrame, keys: list[str], draws: int, seed: int, held: int = 1_000_000) -> DataFrame:
    """``(*keys, pos, _share, draw, _hash)``: the rows that may be among a draw's ``_share`` smallest hashes.

    Each task keeps the smallest of its own rows, for each draw of a document, so
    what is shuffled follows the share and not the number of questions.
    """
    numbers = F.sequence(F.lit(0), F.lit(draws - 1))
    hashes = F.transform(numbers, lambda d: _draw_hash(seed, d, F.col("docid"), F.col("pos")))
    hashed = ids.select(*keys, "pos", "_share", hashes.alias("_hashes"))
    kind = ids.select(*keys, "pos", "_share").schema.add("draw", T.IntegerType()).add("_hash", T.StringType())
    names = kind.names

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def smallest(table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in (*keys, "draw", "_hash", "pos")])
            same = np.ones(max(table.num_rows - 1, 0), bool)
            for column in (*keys, "draw"):
                values = table.column(column).combine_chunks().dictionary_encode()
                codes = values.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                same &= codes[1:] == codes[:-1]
            start = np.zeros(table.num_rows, np.int64)
            fresh = np.flatnonzero(~same) + 1
            start[fresh] = fresh
            place = np.arange(table.num_rows) - np.maximum.accumulate(start)
            return table.filter(pa.array(place < table.column("_share").to_numpy()))

        kept, rows = [], 0
        for batch in batches:
            n = batch.num_rows
            each = pa.array(np.repeat(np.arange(n), draws))
            plain = [batch.column(c).take(each) for c in names[:-2]]
            draw = pa.array(np.tile(np.arange(draws, dtype=np.int32), n))
            table = pa.Table.from_arrays([*plain, draw, batch.column("_hashes").flatten()], names=names)
            kept.append(smallest(table))
            rows += kept[-1].num_rows
            if rows > held:
                whole = smallest(pa.concat_tables(kept))
                if whole.num_rows > held // 2:
                    yield from whole.to_batches()
                    whole = whole.slice(0, 0)
                kept, rows = [whole], whole.num_rows
        if kept:
            yield from smallest(pa.concat_tables(kept)).to_batches()

    return hashed.mapInArrow(run, kind)


def _placed(questions: DataFrame, keys: list[str], ratio: float, draws: int, seed: int) -> DataFrame:
    """``(*keys, pos, _count, draw, _place)``: the first ``ceil(n * ratio)`` questions of each draw, in hash order."""
    ids = questions.select(*keys, "pos")
    sizes = ids.groupBy(*keys).agg(F.count("*").alias("_count"))
    sizes = stage(sizes.withColumn("_share", _share(F.col("_count"), ratio)))
    shared = ids.join(broadcast_within(sizes.drop("_count")) or sizes.drop("_count"), keys)
    drawn = stage(_bottom_of_draws(shared, keys, draws, seed))
    order = [F.col("_hash"), F.col("pos")]
    ranked = rank_all(drawn, order, _hash_bucket(F.col("_hash")), [*keys, "draw"], "_place")
    kept = ranked.where(F.col("_place") <= F.col("_share")).drop("_hash", "_share")
    return kept.join(broadcast_within(sizes.drop("_share")) or sizes.drop("_share"), keys)


def sample_questions(
    questions: DataFrame, ratio: float, draws: int | None = None, seed: int = 0
) -> DataFrame:
    """Keep ``ceil(n * ratio)`` of each document's n questions, once per draw.

    A ratio below 1 is drawn ``DRAWS`` times unless told otherwise. Questions
    are ordered by a hash of seed, draw, document and position, so a draw is
    the same on every run; the hash also splits the ranking of a document's
    questions, however many it has. Only ids are ranked, and positions keep
    their order.
    """
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must be in (0, 1], got {ratio}")
    draws = draws or (DRAWS if ratio < 1 else 1)
    if ratio == 1:
        return questions.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    kept = _placed(questions, ["docid"], ratio, draws, seed)
    return questions.join(kept.select("docid", "pos", "draw"), ["docid", "pos"])


def draw_spreads(vectors: DataFrame, members: DataFrame, keys: list[str], item: str, levels: int = 1) -> DataFrame:
    """``(*keys, cell, spread)``: the spread of each document's questions in every draw at once.

    ``members(*keys, item, cells)`` lists for a question the cells, draw times ``levels``
    plus level, that hold it; a cell also holds what the lower levels of its draw do.
    Tasks multiply the 0/1 matrix of cells by questions with the vectors and with
    their squared lengths, so a vector crosses once however many draws it is in;
    only sums by cell are shuffled.
    """
    joined = vectors.join(members, [*keys, item]).select(*keys, "cells", "vec")
    kind = joined.select(*keys).schema
    kind = kind.add("cell", T.IntegerType()).add("_count", T.LongType())
    kind = kind.add("_squares", T.DoubleType()).add("_sums", T.ArrayType(T.DoubleType()))
    names = kind.names

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            values, codes = as_matrix(batch.column("vec")), np.zeros(batch.num_rows, np.int64)
            for key in keys:
                column = batch.column(key).dictionary_encode()
                codes = codes * (len(column.dictionary) + 1) + column.indices.fill_null(len(column.dictionary)).to_numpy()
            owner = np.unique(codes, return_inverse=True)[1]
            order = np.argsort(owner, kind="stable")
            lists = batch.column("cells")
            cells, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            lengths = (values * values).sum(axis=1)
            found = [[], [], [], [], []]
            for rows in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                at = np.concatenate([np.arange(starts[r], starts[r] + sizes[r]) for r in rows])
                if not len(at):
                    continue
                draws = cells[at].max() // levels + 1
                held = np.zeros((draws * levels, len(rows)))
                np.add.at(held, (cells[at], np.repeat(np.arange(len(rows)), sizes[rows])), 1.0)
                held = held.reshape(draws, levels, -1).cumsum(axis=1).reshape(draws * levels, -1)
                count = held.sum(axis=1)
                used = np.flatnonzero(count)
                sums = held[used] @ values[rows]
                for column, value in zip(found, (np.full(len(used), rows[0]), used, count[used], held[used] @ lengths[rows], sums)):
                    column.append(value)
            if not found[0]:
                continue
            row, cell, count, squares, sums = (np.concatenate(f) for f in found)
            offsets = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
            plain = [batch.column(k).take(pa.array(row)) for k in keys]
            made = [cell.astype(np.int32), count.astype(np.int64), squares]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*plain, *map(pa.array, made), lists], names=names)

    sums = joined.mapInArrow(run, kind).groupBy(*keys, "cell").agg(
        F.sum("_count").alias("_count"),
        F.sum("_squares").alias("_squares"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("_sums")))).alias("_sums"),
    )
    count = F.col("_count")
    mean_length = F.aggregate(F.col("_sums"), F.lit(0.0), lambda s, x: s + x * x) / (count * count)
    # Nearly equal vectors may leave a rounding below zero.
    spread = F.greatest((F.col("_squares") / count - mean_length) / F.size("_sums"), F.lit(0.0))
    return sums.select(*keys, "cell", spread.alias("spread"))


def sampled_scores(
    pairs: DataFrame,
    query_vecs: DataFrame,
    drawn: DataFrame,
    vectors: DataFrame,
    method: str = "max",
    spread_coef: float = SPREAD_COEF,
    item: str = "pos",
) -> DataFrame:
    """Question score of each candidate, averaged over draws of its questions.

    ``drawn(docid, draw, item)`` says which questions a draw holds, and
    ``vectors(docid, pos, vec)``, with the item, their vectors. A similarity
    is computed once and shared by the draws; the spread is one per document
    and draw.
    """
    drawn = drawn.groupBy("docid", item).agg(F.collect_list("draw").alias("cells"))
    members = stage(drawn) if spread_coef else drawn
    sims = similarities(pairs, query_vecs, vectors, (item,))
    stats = (
        sims.join(members, ["docid", item])
        .select("qid", "docid", "sim", F.explode("cells").alias("draw"))
        .groupBy("qid", "docid", "draw")
        .agg(F.max("sim").alias("max_sim"), F.avg("sim").alias("mean_sim"))
    )
    if spread_coef:
        wanted = matching(vectors, pairs, "docid").select("docid", item, "vec")
        spreads = draw_spreads(wanted, members, ["docid"], item).withColumnRenamed("cell", "draw")
        stats = stats.join(spreads, ["docid", "draw"])
    else:
        stats = stats.withColumn("spread", F.lit(0.0))
    scored = stats.withColumn("_score", question_score(method, spread_coef))
    return scored.groupBy("qid", "docid").agg(F.avg("_score").alias("question_score"))


def sampling_statistics(
    pairs: DataFrame,
    query_vecs: DataFrame,
    questions: DataFrame,
    ratios: Sequence[float],
    draws: int = DRAWS,
    seed: int = 0,
    keys: tuple[str, ...] = (),
    with_spread: bool = True,
) -> DataFrame:
    """``(*keys, downsample, qid, docid, max_sim, mean_sim, spread)`` for every ratio from one pass.

    ``questions(*keys, docid, pos, vec)``; ``keys`` tell sets of questions apart, such as the
    number of completions and the temperature that made them. A draw orders a
    document's questions once; a smaller ratio takes a shorter beginning. So a
    question counts from the first ratio that reaches it on, similarities are
    computed once, and best, sum and moments run on over the ratios. All are
    averaged over the draws; scores are linear in them.
    """
    ratios = sorted(ratios)
    if not ratios or not 0 < ratios[0] <= ratios[-1] <= 1:
        raise ValueError(f"ratios must be in (0, 1], got {ratios}")
    own, n = [*keys, "docid"], len(ratios)
    placed = _placed(questions, own, ratios[-1], draws, seed)
    # The first ratio whose share reaches a question.
    level = sum((F.when(F.col("_place") > _share(F.col("_count"), r), 1).otherwise(0) for r in ratios), F.lit(0))
    cell = (F.col("draw") * n + level).cast("int")
    members = stage(placed.groupBy(*own, "pos").agg(F.collect_list(cell).alias("cells")))
    sims = similarities(pairs, query_vecs, questions, (*keys, "pos"))
    counted = (
        sims.join(members, [*own, "pos"])
        .select(*keys, "qid", "docid", "sim", F.explode("cells").alias("cell"))
        .groupBy(*keys, "qid", "docid", "cell")
        .agg(F.max("sim").alias("_best"), F.sum("sim").alias("_total"), F.count("*").alias("_count"))
    )
    onwards = F.explode(F.sequence(F.col("cell") % n, F.lit(n - 1))).alias("ratio")
    stats = (
        counted.select("*", F.floor(F.col("cell") / n).alias("draw"), onwards)
        .groupBy(*keys, "qid", "docid", "draw", "ratio")
        .agg(F.max("_best").alias("max_sim"), (F.sum("_total") / F.sum("_count")).alias("mean_sim"))
    )
    if with_spread:
        wanted = matching(questions, pairs, "docid").select(*own, "pos", "vec")
        spreads = draw_spreads(wanted, members, own, "pos", n).select(
            *own, F.floor(F.col("cell") / n).alias("draw"), (F.col("cell") % n).alias("ratio"), "spread"
        )
        stats = stats.join(spreads, [*own, "draw", "ratio"])
    else:
        stats = stats.withColumn("spread", F.lit(0.0))
    named = F.element_at(F.array(*[F.lit(float(r)) for r in ratios]), F.col("ratio") + 1)
    return (
        stats.groupBy(*keys, named.alias("downsample"), "qid", "docid")
        .agg(*[F.avg(c).alias(c) for c in ("max_sim", "mean_sim", "spread")])
    )


def chunk_documents(docs: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """``(docid, chunk, context)``: overlapping windows of ``size`` words."""
    step = step or math.ceil(size / 2)
    windows = word_windows(F.col("context"), size, step)
    return docs.select("docid", F.posexplode(windows).alias("chunk", "context"))


def prompt_words(prompt: Column) -> Column:
    """Length of a prompt in words."""
    return F.size(F.filter(F.split(prompt, " "), lambda w: w != ""))


def merge_chunk_questions(questions: DataFrame) -> DataFrame:
    """A document's distinct questions over all its chunks."""
    return questions.select("docid", "question").distinct()
