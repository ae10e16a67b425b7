"""Model calls as batch operators: text to vector, prompt to completions.

A model is a callable made by a factory, once per task, inside the Python
worker. Inputs are made distinct first, and results are meant to be written
to a store before they are used, so that no call is paid for twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxrank.functions.text import terms
from ctxrank.functions.vectors import text_key

Encoder = Callable[[Sequence[str]], Sequence]
Generator = Callable[[Sequence[str], int, float], Sequence[Sequence[str | None]]]

# The waits between attempts, in seconds.
WAIT_UNTIL_SUCCESS = 1.0
WAIT_AFTER_RETRY_HINT = 20.0
RETRY_HINTS = ("retry", "try again")

TEST_DIMENSIONS = 32

# Texts of one call of a model, at most.
CALL_ROWS = 512


def retrying(
    call: Callable,
    retries: int | None = 1,
    wait: float = WAIT_AFTER_RETRY_HINT,
    hints: Sequence[str] | None = RETRY_HINTS,
    default=None,
    raises: bool = False,
) -> Callable:
    """Repeat a failing call, and give ``default`` when the attempts run out.

    With ``hints`` only errors that mention one are retried; ``retries=None``
    repeats until success; with ``raises`` the last error is raised instead.
    """

    def attempt(*args):
        done = 0
        while True:
            try:
                return call(*args)
            except Exception as error:
                hinted = hints is None or any(h in str(error) for h in hints)
                if not hinted or (retries is not None and done >= retries):
                    if raises:
                        raise
                    return default
                done += 1
                time.sleep(wait)

    return attempt


def distinct_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(text_key, text)``, each text once; copies combine on the map side."""
    once = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    return once.select(text_key(F.col("text")).alias("text_key"), "text")


def _calls(batches: Iterator) -> Iterator:
    """The rows of Arrow batches, by the few that one call of a model gets and so a task holds."""
    for batch in batches:
        for low in range(0, batch.num_rows, CALL_ROWS):
            yield batch.slice(low, CALL_ROWS)


def encode_texts(
    texts: DataFrame, make_encoder: Callable[[], Encoder], tasks: int | None = None
) -> DataFrame:
    """``(text_key, text)`` -> ``(text_key, vec)`` through an encoder.

    ``tasks`` spreads the calls: their cost is in the model, not in bytes, so
    the small inputs must not be merged into few partitions.
    """
    if tasks is not None:
        texts = texts.repartition(tasks, "text_key")

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = make_encoder()
        for batch in _calls(batches):
            vectors = encoder(batch.column("text").to_pylist())
            flat = [np.asarray(v, dtype="float64").ravel() for v in vectors]
            columns = [batch.column("text_key"), pa.array(flat, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "vec"])

    return texts.select("text_key", "text").mapInArrow(
        encode, "text_key STRING, vec ARRAY<DOUBLE>"
    )


def generate(
    prompts: DataFrame,
    make_generator: Callable[[], Generator],
    n: int = 1,
    temperature: float = 0.1,
    tasks: int | None = None,
    retries: int | None = 0,
    wait: float = WAIT_AFTER_RETRY_HINT,
    hints: Sequence[str] | None = RETRY_HINTS,
    raises: bool = True,
) -> DataFrame:
    """``(prompt_key, prompt)`` -> ``(prompt_key, choice, text)`` through a generator.

    The prompts of a failed batch are asked again one by one, each with the
    ``retries``, ``wait`` and ``hints`` of ``retrying``. One that still fails
    raises, or without ``raises`` gets a null text, which parsing drops; so
    does every prompt of a batch that the generator answers with ``None``.
    """
    if tasks is not None:
        prompts = prompts.repartition(tasks, "prompt_key")

    def complete(batches: Iterator) -> Iterator:
        import pyarrow as pa

        generator = make_generator()

        def ask(prompts: list[str]) -> Sequence:
            answers = generator(prompts, n, temperature)
            return [None] * len(prompts) if answers is None else answers

        one = retrying(ask, retries, wait, hints, [None], raises)
        for batch in _calls(batches):
            keys, choices, texts = [], [], []
            prompts = batch.column("prompt").to_pylist()
            try:
                answers = ask(prompts)
            except Exception:
                answers = [one([prompt])[0] for prompt in prompts]
            for key, answer in zip(batch.column("prompt_key").to_pylist(), answers, strict=True):
                answer = list(answer or [None])
                keys += [key] * len(answer)
                choices += range(len(answer))
                texts += answer
            columns = [pa.array(keys, pa.string()), pa.array(choices, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["prompt_key", "choice", "text"])

    return prompts.select("prompt_key", "prompt").mapInArrow(
        complete, "prompt_key STRING, choice INT, text STRING"
    )


def test_vectors(
    texts: DataFrame, key: str, text: str, dimensions: int = TEST_DIMENSIONS
) -> DataFrame:
    """Stand-in encoder: ``(key, vec)``, term counts hashed into a few dimensions.

    Terms are counted where their text is, so only one row per text and task
    is shuffled.
    """
    words = texts.select(key, F.explode_outer(terms(F.col(text))).alias("term"))
    digest = F.substring(F.md5(F.col("term").cast("binary")), 1, 8)
    hashed = words.select(
        key, (F.conv(digest, 16, 10).cast("bigint") % dimensions).alias("d")
    )
    counts = [F.count_if(F.col("d") == d).cast("double") for d in range(dimensions)]
    return hashed.groupBy(key).agg(F.array(*counts).alias("vec"))


def test_completion(text: Column) -> Column:
    """Stand-in generator: each sentence of a text as one numbered question."""
    questions = F.replace(text, F.lit(". "), F.lit("?\n2. "))
    return F.concat(F.lit("Questions:\n1. "), questions, F.lit("####tail"))


def make_test_encoder(dimensions: int = TEST_DIMENSIONS) -> Encoder:
    """The stand-in encoder as a callable, for the batch operator."""
    import hashlib

    import numpy as np
    import regex

    letters = regex.compile(r"\p{L}+")

    def encode(texts):
        vectors = np.zeros((len(texts), dimensions))
        for row, text in zip(vectors, texts):
            for term in letters.findall(text.lower()):
                row[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dimensions] += 1
        return vectors

    return encode


def make_hash_encoder(dimensions: int = 16, salt: str = "") -> Encoder:
    """A stand-in encoder whose vectors are hashes of the whole text, so that no two scores tie."""
    import hashlib

    import numpy as np

    def number(text: str, d: int) -> float:
        digest = hashlib.md5(f"{salt}{text}:{d}".encode()).hexdigest()
        return int(digest[:8], 16) / 2.0**32 - 0.5

    return lambda texts: np.array([[number(t, d) for d in range(dimensions)] for t in texts])


def make_test_generator() -> Generator:
    """The stand-in generator as a callable; it reads the passage out of the prompt."""

    def complete(prompts, n, temperature):
        passages = [p.split("<passage>")[-1].split("\n</passage>")[0] for p in prompts]
        texts = ["Questions:\n1. " + p.replace(". ", "?\n2. ") + "####tail" for p in passages]
        return [[text] * n for text in texts]

    return complete
