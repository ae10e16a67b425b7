"""Dataset registry: a topic set and an index resolve to table paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The topic sets and indexes that can be named.
PASSAGE_TOPICS = ("dl19-passage", "dl20-passage", "dl21-passage", "dl22-passage")
BEIR_TOPICS = (
    "beir-v1.0.0-trec-news-test",
    "beir-v1.0.0-trec-covid-test",
    "beir-v1.0.0-fever-test",
    "beir-v1.0.0-scidocs-test",
    "beir-v1.0.0-cqadupstack-android-test",
    "beir-v1.0.0-webis-touche2020-test",
)
DENSE_INDEXES = ("contriever", "bge-base-en-v1.5")
SPARSE_INDEXES = ("SPLADE++_EnsembleDistil_ONNX",)
# What an index name may begin with, and the index that any name with it means.
PASSAGE_PREFIXES = ("hyde_", "hyde-", "hyd-")
BEIR_FAMILY = "contriever"


@dataclass(frozen=True)
class Dataset:
    """Paths of one topic set and index below a root folder."""

    topics: str
    qrels: str
    corpus: str
    index: str
    sparse: bool

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The four tables, read as parquet."""
        paths = {"topics": self.topics, "qrels": self.qrels, "corpus": self.corpus}
        return {name: spark.read.parquet(path) for name, path in {**paths, "index": self.index}.items()}


def index_name(topic: str, indexer: str) -> str:
    """The index that ``indexer`` means for a topic set.

    The passages prefix of a name says how the index is searched and not which it
    is. For the BEIR sets any name with ``contriever`` in it means that index.
    """
    for prefix in PASSAGE_PREFIXES:
        indexer = indexer.removeprefix(prefix)
    if topic in BEIR_TOPICS and BEIR_FAMILY in indexer:
        return BEIR_FAMILY
    if indexer not in DENSE_INDEXES + SPARSE_INDEXES:
        raise ValueError(f"unknown index {indexer!r}")
    return indexer


def resolve(root: str, topic: str, indexer: str) -> Dataset:
    """Where the tables of a topic set and index lie; unknown names are an error."""
    if topic in PASSAGE_TOPICS:
        corpus = "msmarco-v1-passage"
    elif topic in BEIR_TOPICS:
        corpus = topic.removesuffix("-test")
    else:
        raise ValueError(f"unknown topic set {topic!r}")
    indexer = index_name(topic, indexer)
    return Dataset(
        topics=f"{root}/topics/{topic}",
        qrels=f"{root}/qrels/{topic}",
        corpus=f"{root}/corpus/{corpus}",
        index=f"{root}/index/{corpus}.{indexer}",
        sparse=indexer in SPARSE_INDEXES,
    )
