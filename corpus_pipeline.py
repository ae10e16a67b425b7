"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of the
documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxrank.llm import decision_list, decontamination, lines, ngram_join, packing
from ctxrank.llm.tables import table
from ctxrank.session import new_folder

# Near duplicates in the pipeline: the library's setting for stages on shingles.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject.

    Null and empty texts have no words and go. Rows are judged one by one, so repeated rows
    and null ids stay or go alike. Without labels only the base rules reject.
    """
    return decision_list.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later one holds too.

    A document that loses all lines stays, with an empty text. Of repeated rows, and of rows
    with the largest id of a line, each keeps it; a null id is the smallest.
    """
    return lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Ties of the id go by a hash of the text; of repeated rows one stays. Documents without
    words belong to no group and stay, null ids are the smallest.
    """
    return ngram_join.first_of_each(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark.

    Null and empty texts have no words and stay, repeated rows stay or go together; an
    empty benchmark keeps everything.
    """
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, and where they lie in which sequence.

    A null or empty text is the end id alone; repeated rows are packed as often as they stand.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

# Learned rules and tokenizer ids are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents; each is staged for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
