from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

# Columns whose names the operators use inside.
SCHEMA = (
    T.StructType()
    .add("doc_id", "long")
    .add("text", "string")
    .add("n_chars", "long")
    .add("sid", "string")
    .add("n", "long")
    .add("keep", "string")
    .add("whole", "string")
    .add("row", "string")
)
LABELS = T.StructType().add("doc_id", "long").add("quality", "integer").add("toxic", "integer")
ITEMS = T.StructType().add("item_id", "long").add("text", "string")


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    vocabulary = [f"w{r.randrange(10**6)}" for _ in range(max(words, 1))]
    lines = [" ".join(vocabulary[i : i + 12]) for i in range(0, words, 12)]
    return "\n".join(lines)


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    base, common = prose(1, 300), " ".join(f"c{i}" for i in range(90))
    words = base.split(" ")
    near = [" ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in (20, 90, 200)]
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "Äb é 中文 🙂 ok")]
    rows += [(7, base), (8, base), (8, base), (9, base.upper()), *[(10 + i, t) for i, t in enumerate(near)]]
    rows += [(20 + i, prose(50 + i, 60) + "\n" + common + "\n" + prose(90 + i, 40)) for i in range(8)]
    rows += [(30, prose(7, 30_000)), (31, "das " * 5000), (32, "a\x00b " * 50), (33, prose(1, 300) + "\nmore")]
    rows += [(None, base), (None, prose(11, 80)), (40, prose(12, 80)), (40, prose(13, 80))]
    return rows


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    rows = [(d, t, len(t or ""), "s", 1, "k", "w", "r") for d, t in edge_texts()]
    path = str(tmp_path_factory.mktemp("edges") / "documents")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)
