"""Stores, files, model operators, sampling and the whole ranking."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ctxrank.functions.vectors import text_key
from ctxrank.operators.conversation import conversation_prompts
from ctxrank.operators.hypodocs import averaged_queries
from ctxrank.operators.models import (
    distinct_texts,
    encode_texts,
    generate,
    make_test_encoder,
    make_test_generator,
    retrying,
    test_vectors as stand_in_vectors,
)
from ctxrank.operators.questions import (
    cut_no_content,
    distinct_prompts,
    document_questions,
    order_completions,
    parse,
    parse_documents,
    prompts,
    sample_questions,
)
from ctxrank.plans.end_to_end import Setting, end_to_end
from ctxrank.session import broadcast_within, shared_folder, table_bytes
from ctxrank.sources.catalog import resolve
from ctxrank.sources.experiments import append_experiments, read_experiments
from ctxrank.sources.store import generated_store, overlay, store_name, vector_store
from ctxrank.sources.trec import read_corpus, read_qrels, read_run, read_topics, write_run


def questions(spark, lists):
    rows = [(d, p, q) for d, qs in lists.items() for p, q in enumerate(qs)]
    return spark.createDataFrame(rows, "docid INT, pos INT, question STRING")


def by_document(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["docid"], r["pos"])):
        found.setdefault(r["docid"], []).append(r["question"])
    return found


def test_no_content_cut(spark):
    lists = {
        1: ["No Content"],
        2: ["a question", "No Content", "another question"],
        3: ["No Content", "a question"],
        4: ["a question"],
        5: ["one", "two", "says no content here", "no content"],
    }
    assert by_document(cut_no_content(questions(spark, lists))) == {
        1: ["no content"], 2: ["a question"], 3: ["no content"], 4: ["a question"], 5: ["one", "two"],
    }


@pytest.mark.parametrize("ratio", [0.1, 0.5, 0.75])
def test_sampling_keeps_the_rounded_up_share(spark, ratio):
    sizes = {1: 1, 2: 2, 3: 7, 4: 400}
    table = questions(spark, {d: [f"q{p}" for p in range(n)] for d, n in sizes.items()})
    drawn = sample_questions(table, ratio).collect()
    counts = {}
    for r in drawn:
        counts[r["docid"], r["draw"]] = counts.get((r["docid"], r["draw"]), 0) + 1
    assert counts == {(d, i): math.ceil(n * ratio) for d, n in sizes.items() for i in range(10)}
    again = sample_questions(table.repartition(3), ratio).collect()
    assert sorted(again) == sorted(drawn)
    first = {r["pos"] for r in drawn if (r["docid"], r["draw"]) == (4, 0)}
    second = {r["pos"] for r in drawn if (r["docid"], r["draw"]) == (4, 1)}
    assert first != second


def test_sampling_all(spark):
    table = questions(spark, {1: ["a", "b"]})
    assert [r["draw"] for r in sample_questions(table, 1.0).collect()] == [0, 0]
    with pytest.raises(ValueError):
        sample_questions(table, 0.0)


def test_positions_run_on_over_choices(spark):
    rows = [("k", 0, "first question\nsecond question"), ("k", 1, None), ("k", 2, "third question####x"),
            ("e", 0, "")]
    completions = spark.createDataFrame(rows, "prompt_key STRING, choice INT, text STRING")
    found = sorted(tuple(r) for r in parse(completions).collect())
    assert found == [("k", 0, "first question"), ("k", 1, "second question"), ("k", 2, "third question")]
    lines = spark.createDataFrame([("k", 0, " a \n\nb"), ("k", 1, "c\n")], completions.schema)
    assert sorted(tuple(r) for r in parse_documents(lines).collect()) == [
        ("k", 0, "a"), ("k", 1, ""), ("k", 2, "b"), ("k", 3, "c"),
    ]


def test_completion_order_keeps_ties(spark):
    rows = [("k", 0, [-1.0, -2.0]), ("k", 1, [-0.5]), ("k", 2, [-3.0]), ("k", 3, [-0.5])]
    table = spark.createDataFrame(rows, "prompt_key STRING, choice INT, logprobs ARRAY<DOUBLE>")
    found = {r["choice"]: r["place"] for r in order_completions(table).collect()}
    assert found == {1: 1, 3: 2, 0: 3, 2: 4}


def test_guard_needs_no_model(spark):
    docs = spark.createDataFrame([(1, "Title: T Content:"), (2, "words")], "docid INT, context STRING")
    asked = prompts(docs, "questions2")
    assert distinct_prompts(asked).count() == 1
    none = spark.createDataFrame([], "prompt_key STRING, pos INT, question STRING")
    assert by_document(document_questions(asked, none)) == {1: ["no content"]}


def test_conversation_prompt(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", "s")]
    table = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")
    found = {r["conv_id"]: r["prompt"] for r in conversation_prompts(table).collect()}
    assert found == {1: "user: a\nassistant: b\nassistant: ", 2: "system: s\nassistant: "}
    parts = conversation_prompts(table, turns_per_part=1).where("conv_id = 1").orderBy("part").collect()
    assert "\n".join(r["prompt"] for r in parts) == found[1]


def test_averaged_query(spark):
    own = spark.createDataFrame([(1, [1.0, 1.0]), (2, [5.0, 0.0])], "qid INT, vec ARRAY<DOUBLE>")
    passages = spark.createDataFrame([(1, [3.0, 1.0]), (1, [2.0, 4.0]), (9, [0.0, 0.0])], own.schema)
    found = {r["qid"]: r["vec"] for r in averaged_queries(own, passages).collect()}
    assert found == {1: [2.0, 2.0], 2: [5.0, 0.0]}


def test_overlay(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k INT, v STRING")
    b = spark.createDataFrame([(2, "b"), (3, "b"), (3, "c")], "k INT, v STRING")
    assert sorted(tuple(r) for r in overlay(a, b, "k").collect()) == [(1, "a"), (2, "a"), (3, "b"), (3, "c")]


def test_store_computes_only_what_it_lacks(spark, tmp_path):
    store = generated_store(str(tmp_path / "s"), "questions", "org/model", "t")
    other = generated_store(str(tmp_path / "s"), "questions", "org/model", "t", temperature=1.0, n=2)
    asked = []

    def answer(wanted):
        asked.append(sorted(r["prompt_key"] for r in wanted.collect()))
        return wanted.where("prompt_key <> 'empty'").select("prompt_key", F.lit(0).alias("pos"), F.lit("q").alias("text"))

    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "prompt_key STRING")
    assert store.fill(keys("a", "empty"), answer).count() == 1
    assert store.fill(keys("a", "b", "empty"), answer).count() == 2
    assert other.fill(keys("a"), answer).count() == 1
    # A prompt without any question has no row, so it is asked again.
    assert asked == [["a", "empty"], ["b", "empty"], ["a"]]
    assert (store.count(spark), other.count(spark)) == (2, 1)
    assert store.require(keys("a", "b")).count() == 2
    with pytest.raises(LookupError):
        store.require(keys("a", "z"))


def test_store_names():
    assert store_name("org/m", "t", 0.1, 1) == "m_t"
    assert store_name("m", "t", 1.0, 1) == "m_t_temperature_1.0_n_1"


def test_encoder_sees_each_text_once(spark):
    table = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text STRING")
    texts = distinct_texts(table)
    assert texts.count() == 2
    found = {r["text_key"]: r["vec"] for r in encode_texts(texts, make_test_encoder, 3).collect()}
    expected = stand_in_vectors(table.where("text is not null").dropDuplicates(), "text", "text")
    keyed = expected.select(text_key(F.col("text")).alias("k"), "vec").collect()
    assert found == {r["k"]: r["vec"] for r in keyed}


def test_generator_choices_and_failures(spark):
    def make():
        return lambda ps, n, t: [None if "bad" in p else [p] * n for p in ps]

    rows = spark.createDataFrame([("1", "good"), ("2", "bad")], "prompt_key STRING, prompt STRING")
    found = sorted(tuple(r) for r in generate(rows, make, n=2).collect())
    assert found == [("1", 0, "good"), ("1", 1, "good"), ("2", 0, None)]


def test_retrying():
    def failing(times, message):
        left = [times]

        def call(x):
            if left[0]:
                left[0] -= 1
                raise RuntimeError(message)
            return x

        return call

    assert retrying(failing(1, "please retry"), wait=0)(5) == 5
    assert retrying(failing(2, "please retry"), wait=0, default="none")(5) == "none"
    assert retrying(failing(1, "broken"), wait=0)(5) is None
    assert retrying(failing(4, "broken"), retries=None, wait=0, hints=None)(5) == 5


def test_run_files(spark, tmp_path):
    folder = str(tmp_path / "runs")
    rows = [(f"q{q}", f"d{d}", d + 1, 1.0 / (d + 1)) for q in range(3) for d in range(150)]
    hits = spark.createDataFrame(rows, "qid STRING, docid STRING, rank INT, score DOUBLE").repartition(5)
    write_run(hits, folder, "one")
    write_run(hits.where("qid = 'q1'"), folder, "two")
    write_run(hits, folder, "one")
    assert read_run(spark, folder, "one").count() == 300
    assert {r["run_id"]: r["count"] for r in read_run(spark, folder).groupBy("run_id").count().collect()} == {
        "one": 300, "two": 100,
    }
    lines = spark.read.text(f"{folder}/run_id=two").collect()
    assert lines[0]["value"] == "q1 Q0 d0 1 1.0 rank"


def test_text_sources(spark, tmp_path):
    (tmp_path / "topics").write_text("1\twhat is x\n2\ta\tb \n")
    (tmp_path / "qrels").write_text("1 0 d1 2\n1\t0\td2\t0\n\n")
    (tmp_path / "corpus").write_text('{"id":"d1","contents":"a"}\n{"_id":"d2","title":"t","text":"b"}\n')
    assert [tuple(r) for r in read_topics(spark, str(tmp_path / "topics")).collect()] == [
        ("1", "what is x"), ("2", "a\tb"),
    ]
    assert [tuple(r) for r in read_qrels(spark, str(tmp_path / "qrels")).collect()] == [
        ("1", "d1", 2), ("1", "d2", 0),
    ]
    assert {r["docid"] for r in read_corpus(spark, str(tmp_path / "corpus")).collect()} == {"d1", "d2"}


def test_experiment_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert read_experiments(spark, folder).count() == 0
    append_experiments(spark, [{"topic": "t", "spread_coef": 0.5, "n": 2}], folder)
    append_experiments(spark, [{"topic": "u"}], folder)
    rows = {r["topic"]: r for r in read_experiments(spark, folder).collect()}
    assert rows["t"]["spread_coef"] == 0.5 and rows["t"]["n"] == 2 and rows["t"]["downsample"] is None
    assert rows["u"]["n"] is None


def test_registry():
    dense = resolve("/data", "beir-v1.0.0-trec-news-test", "contriever")
    assert dense.index == "/data/index/beir-v1.0.0-trec-news.contriever" and not dense.sparse
    assert resolve("/data", "dl20-passage", "SPLADE++_EnsembleDistil_ONNX").sparse
    for topic, index in (("nope", "contriever"), ("dl19-passage", "nope")):
        with pytest.raises(ValueError):
            resolve("/data", topic, index)


def test_broadcast_needs_a_size_check(spark):
    table = spark.createDataFrame([(i, "x" * 10, [1.0] * 4) for i in range(100)], "a INT, b STRING, c ARRAY<DOUBLE>")
    assert table_bytes(table) == 100 * (16 + 34 + 56)
    assert broadcast_within(table, 10_600) is not None
    assert broadcast_within(table, 10_599) is None


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()
    assert named is None or named in shared_folder(spark)


@pytest.mark.parametrize("encoder,base", [("counts", "first"), ("other", "vectors"), ("hyde-counts", "passages")])
def test_whole_ranking_on_each_branch(spark, tmp_path, encoder, base):
    docs = [(f"d{i}", f"apple {'pear ' * (i % 4)}plum. What about kiwi {i}. More fig") for i in range(12)]
    corpus = spark.createDataFrame(
        [(d, '{"contents": "' + t + '"}') for d, t in docs], "docid STRING, raw STRING"
    )
    topics = spark.createDataFrame(
        [("1", "apple pear"), ("2", "kiwi fig"), ("3", "unjudged")], "qid STRING, title STRING"
    )
    qrels = spark.createDataFrame([("1", "d3", 1), ("2", "d5", 2)], "qid STRING, docid STRING, rel INT")
    texts = spark.createDataFrame(docs, "docid STRING, context STRING")
    setting = Setting(indexer="counts", encoder=encoder, first_n=5, downsample=0.5 if base == "first" else 1.0)
    assert setting.base == base
    calls = str(tmp_path / "calls")

    def counted():
        inner = make_test_generator()

        def complete(prompts, n, temperature):
            with open(calls, "a") as log:
                log.writelines("x\n" for _ in prompts)
            return inner(prompts, n, temperature)

        return complete

    def go():
        return end_to_end(
            setting, topics, qrels, corpus,
            stand_in_vectors(topics, "qid", "title"), stand_in_vectors(texts, "docid", "context"),
            generated_store(str(tmp_path / "g"), "questions", "m", "t"),
            generated_store(str(tmp_path / "g"), "passages", "m", "t"),
            vector_store(str(tmp_path / "v"), "counts", "t"),
            counted, make_test_encoder, tasks=2,
        )

    runs = go()
    assert {r["qid"] for r in runs.first.collect()} == {"1", "2"}
    assert runs.reranked.count() == runs.base.count() == 24
    for run in (runs.first, runs.base, runs.reranked):
        ranks = sorted(r["rank"] for r in run.where("qid = '1'").collect())
        assert ranks == list(range(1, 13))
    scores = {r["run_id"]: r["ndcg"] for r in runs.compare(qrels).collect()}
    assert set(scores) == {"first", "base", "reranked"} and all(0 < s <= 1 for s in scores.values())
    written = len(open(calls).readlines())
    again = go()
    assert len(open(calls).readlines()) == written
    assert sorted(again.reranked.collect()) == sorted(runs.reranked.collect())


def test_a_conversation_is_one_prompt_at_every_size(spark):
    sizes = [999, 1000, 1001, 1500]
    rows = [(n, t, "user", str(t)) for n in sizes for t in range(n)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r["prompt"] for r in conversation_prompts(table).collect()}
    assert found == {n: "\n".join([*(f"user: {t}" for t in range(n)), "assistant: "]) for n in sizes}
    assert conversation_prompts(table).count() == len(sizes)


def test_run_ids_stay_as_written(spark, tmp_path):
    from ctxrank.sources.trec import read_run

    (tmp_path / "run_id=007").mkdir()
    (tmp_path / "run_id=007" / "part.txt").write_text("1 Q0 d 1 0.5 x\n")
    assert [r["run_id"] for r in read_run(spark, str(tmp_path)).collect()] == ["007"]


def _failing_generator(gives_up):
    def make():
        def complete(prompts, n, temperature):
            if any("bad" in p for p in prompts):
                if gives_up:
                    return None
                raise ValueError("please retry")
            return [[p.upper()] * n for p in prompts]

        return complete

    return make


def _completions(spark, gives_up, **options):
    prompts = spark.createDataFrame([("1", "good"), ("2", "bad")], "prompt_key string, prompt string")
    rows = generate(prompts.coalesce(1), _failing_generator(gives_up), wait=0.0, **options).collect()
    return {r.prompt_key: r.text for r in rows}


def test_a_failed_prompt_does_not_take_its_batch_along(spark):
    assert _completions(spark, False, retries=2, raises=False) == {"1": "GOOD", "2": None}


def test_a_failed_prompt_raises_unless_told_otherwise(spark):
    with pytest.raises(Exception, match="please retry"):
        _completions(spark, False, retries=1)


def test_a_batch_given_up_is_null_per_prompt(spark):
    assert _completions(spark, True) == {"1": None, "2": None}
