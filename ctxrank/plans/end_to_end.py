"""The whole ranking: first stage, second embedding, question rerank, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrank.functions.prompts import build_prompt, question_task
from ctxrank.functions.vectors import text_key
from ctxrank.operators.hypodocs import passage_vectors, search_with_passages
from ctxrank.operators.models import Encoder, Generator, distinct_texts, encode_texts, generate
from ctxrank.operators.questions import (
    contexts,
    cut_no_content,
    distinct_prompts,
    document_questions,
    parse,
    parse_documents,
    prompts,
    question_vectors,
    sample_questions,
    sampled_scores,
    whole_completions,
)
from ctxrank.operators.rerank import (
    FIRST_N,
    QUESTION_COEF,
    SPREAD_COEF,
    head,
    rerank_by_questions,
    rerank_by_vector,
    score_candidates,
)
from ctxrank.operators.search import dense_topk, judged, sparse_topk
from ctxrank.plans.sweep import compare
from ctxrank.session import stage
from ctxrank.sources.experiments import append_experiments
from ctxrank.sources.store import Store
from ctxrank.sources.trec import write_run

DEPTH = 100


@dataclass(frozen=True)
class Setting:
    """Names and numbers of one ranking run."""

    topic: str = ""
    indexer: str = "contriever"
    encoder: str = "contriever"
    task: str = "web-search"
    method: str = "max"
    first_n: int = FIRST_N
    question_coef: float = QUESTION_COEF
    spread_coef: float = SPREAD_COEF
    downsample: float = 1.0
    temperature: float = 0.1
    n: int = 1
    passages: int = 8
    tail: str = "penalise"

    @property
    def base(self) -> str:
        """What comes between the first stage and the question rerank."""
        if self.encoder == self.indexer:
            return "first"
        return "passages" if "hyd" in self.encoder else "vectors"


@dataclass(frozen=True)
class Runs:
    """The three rankings an evaluation compares."""

    first: DataFrame
    base: DataFrame
    reranked: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {"first": self.first, "base": self.base, "reranked": self.reranked}

    def compare(self, qrels: DataFrame) -> DataFrame:
        """Mean nDCG of the three, one row per ``run_id``."""
        return compare(self.named(), qrels)

    def log_row(self, qrels: DataFrame, setting: Setting, model: str = "") -> DataFrame:
        """The log's row for these runs: the setting, the time and the three means."""
        ndcg = {
            f"{column}_ndcg": F.max(F.when(F.col("run_id") == name, F.col("ndcg")))
            for name, column in (("first", "indexer"), ("base", "encoder"), ("reranked", "reranked"))
        }
        values = {
            "model_name": model,
            "method": setting.method,
            "task": setting.task,
            "topic": setting.topic,
            "question_coef": setting.question_coef,
            "spread_coef": setting.spread_coef,
            "downsample": setting.downsample,
            "temperature": setting.temperature,
            "n": setting.n,
            "indexer_name": setting.indexer,
            "first_n": setting.first_n,
            "encoder_name": setting.encoder,
        }
        means = self.compare(qrels).agg(*[value.alias(c) for c, value in ndcg.items()])
        named = {c: F.lit(value) for c, value in values.items()}
        return means.withColumns({"datetime": F.current_timestamp().cast("string"), **named})

    def write(
        self, qrels: DataFrame, setting: Setting, run_folder: str, log: str, model: str = ""
    ) -> None:
        """Write the three as run files, cut at their depth, and append their row to the log."""
        for name, run in self.named().items():
            write_run(run, run_folder, name)
        append_experiments(qrels.sparkSession, self.log_row(qrels, setting, model), log)


def first_stage(
    topics: DataFrame, qrels: DataFrame, queries: DataFrame, index: DataFrame, k: int, sparse: bool
) -> DataFrame:
    """Top-k hits of the judged topics; dense by vector or sparse by term weight."""
    wanted = judged(queries, judged(topics, qrels))
    return sparse_topk(wanted, index, k) if sparse else dense_topk(wanted, index, k)


def question_prompts(docids: DataFrame, corpus: DataFrame, topic: str) -> DataFrame:
    """Question prompt of each wanted document, by the topic set's task."""
    return prompts(contexts(docids, corpus), question_task(topic)).select(
        "docid", "prompt", "prompt_key", "empty"
    )


def ask(
    asked: DataFrame,
    store: Store,
    make_generator: Callable[[], Generator],
    setting: Setting,
    tasks: int | None = None,
) -> DataFrame:
    """``(docid, pos, question)``, generating only what the store lacks."""

    def answers(missing: DataFrame) -> DataFrame:
        completions = generate(missing, make_generator, setting.n, setting.temperature, tasks)
        return parse(completions).withColumnRenamed("question", "text")

    stored = store.fill(distinct_prompts(asked), answers)
    return document_questions(asked, stored.withColumnRenamed("text", "question"))


def embed(
    texts: DataFrame,
    store: Store,
    make_encoder: Callable[[], Encoder] | None,
    text: str = "text",
    tasks: int | None = None,
    mode: str = "fill",
) -> DataFrame:
    """``(text_key, vec)`` of the texts, encoding only what the store lacks.

    ``mode="overwrite"`` encodes all of them again and replaces what is stored;
    ``mode="stored"`` encodes nothing and fails if a text is not stored.
    """
    wanted = distinct_texts(texts, text)
    if mode == "fill":
        return store.fill(wanted, lambda missing: encode_texts(missing, make_encoder, tasks))
    if mode == "overwrite":
        return store.refill(wanted, lambda all_: encode_texts(all_, make_encoder, tasks))
    if mode == "stored":
        return store.require(wanted)
    raise ValueError(f"mode must be 'fill', 'overwrite' or 'stored', got {mode!r}")


def passage_search(
    topics: DataFrame,
    query_vecs: DataFrame,
    docs: DataFrame,
    setting: Setting,
    passage_store: Store,
    text_store: Store,
    make_generator: Callable[[], Generator],
    make_encoder: Callable[[], Encoder],
    tasks: int | None = None,
    whole: bool = False,
    k: int = DEPTH,
) -> DataFrame:
    """Search with the averaged vectors of each topic and its written passages.

    A passage is a line of a completion, or with ``whole`` a completion.
    """
    read = whole_completions if whole else parse_documents
    asked = topics.withColumn("prompt", build_prompt(F.col("title"), setting.task))
    asked = asked.select("qid", text_key(F.col("prompt")).alias("prompt_key"), "prompt")
    wanted = asked.select("prompt_key", "prompt").distinct()

    def answers(missing: DataFrame) -> DataFrame:
        written = generate(missing, make_generator, setting.passages, setting.temperature, tasks)
        return read(written).withColumnRenamed("passage", "text")

    passages = passage_store.fill(wanted, answers)
    vectors = embed(passages, text_store, make_encoder, "text", tasks)
    written = passage_vectors(asked, passages.withColumnRenamed("text", "passage"), vectors)
    return search_with_passages(query_vecs, written, docs, k)


def rank(
    hits: DataFrame,
    query_vecs: DataFrame,
    answers: DataFrame,
    setting: Setting,
    embed_questions: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Rerank hits by their documents' questions, ``answers(docid, pos, question)``.

    With a downsampling ratio the questions are drawn first, and each draw is
    cut on its own.
    """
    pairs = head(hits, setting.first_n)
    if setting.downsample < 1:
        drawn = sample_questions(answers, setting.downsample)
        drawn = cut_no_content(drawn, ("docid", "draw"))
        drawn = stage(drawn.withColumn("text_key", text_key(F.col("question"))))
        each = drawn.groupBy("docid", "text_key", "question").agg(F.min("pos").alias("pos"))
        vectors = question_vectors(each, embed_questions(drawn))
        scores = sampled_scores(
            pairs, query_vecs, drawn, vectors, setting.method, setting.spread_coef, "text_key"
        )
    else:
        questions = stage(cut_no_content(answers))
        vectors = question_vectors(questions, embed_questions(questions))
        scores = score_candidates(
            pairs, query_vecs, vectors, setting.method, setting.spread_coef
        )
    return rerank_by_questions(
        hits, scores, setting.question_coef, setting.first_n, setting.tail
    )


def end_to_end(
    setting: Setting,
    topics: DataFrame,
    qrels: DataFrame,
    corpus: DataFrame,
    index_queries: DataFrame,
    index: DataFrame,
    question_store: Store,
    passage_store: Store,
    text_store: Store,
    make_generator: Callable[[], Generator],
    make_encoder: Callable[[], Encoder],
    sparse: bool = False,
    tasks: int | None = None,
) -> Runs:
    """Rank the judged topics and return the first, the base and the final run.

    What several later steps read is staged, so that the corpus and the index
    are scanned once per step; the stores make sure that no text is generated
    or encoded twice.
    """
    topics = stage(judged(topics, qrels))
    if setting.base == "passages" and sparse:
        raise ValueError("passage search needs a dense index")
    first = stage(first_stage(topics, qrels, index_queries, index, DEPTH, sparse))

    title_vecs = embed(topics, text_store, make_encoder, "title", tasks)
    titled = topics.select("qid", text_key(F.col("title")).alias("text_key"))
    query_vecs = titled.join(title_vecs, "text_key").select("qid", "vec")

    if setting.base == "first":
        base = first
    elif setting.base == "passages":
        base = stage(
            passage_search(
                topics, query_vecs, index, setting, passage_store, text_store,
                make_generator, make_encoder, tasks,
            )
        )
    else:
        texts = stage(contexts(first, corpus).withColumn("text_key", text_key(F.col("context"))))
        vectors = embed(texts, text_store, make_encoder, "context", tasks)
        doc_vecs = texts.select("docid", "text_key").join(vectors, "text_key")
        base = stage(rerank_by_vector(first, query_vecs, doc_vecs, DEPTH))

    asked = stage(question_prompts(head(base, setting.first_n), corpus, setting.topic))
    answers = stage(ask(asked, question_store, make_generator, setting, tasks))
    reranked = rank(
        base, query_vecs, answers, setting,
        lambda texts: embed(texts, text_store, make_encoder, "question", tasks),
    )
    return Runs(first, base, stage(reranked))
