"""Session helpers: settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
# Bytes of rows of a task whose working memory is many times its rows.
TASK_BYTES = 8 << 20

# Codec of staged and stored tables; texts take a third less than by the default.
CODEC = "zstd"

# Paths of the tables staged so far, and the tables by path that a block of ``staging`` has staged.
_STAGED: list[str] = []
_BLOCK: ContextVar[dict[str, DataFrame] | None] = ContextVar("block", default=None)

# Settings for a cluster session. Partitions of the vector scan are large so
# that each task's running top-k covers many rows; AQE sizes the shuffles.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "ctxrank", **settings: str) -> SparkSession:
    """A session with ``SETTINGS``, overridden by ``settings``."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="ctxrank-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and read it from there.

    As a parquet table it survives the loss of executors, and later steps
    read only the columns and rows they need and know its size.
    """
    path = new_folder(df.sparkSession, "stage")
    df.write.option("compression", CODEC).parquet(path)
    _STAGED.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if (block := _BLOCK.get()) is not None:
        block[path] = table
    return table


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Gives a function that deletes what the block has staged so far, but for the tables it is given.

    So rounds that stage their tables hold those of one round, however many there are.
    """
    block: dict[str, DataFrame] = {}
    outer = _BLOCK.set(block)

    def keep_only(*tables: DataFrame) -> None:
        for path in [path for path, table in block.items() if not any(table is kept for kept in tables)]:
            del block[path]
            if path in _STAGED:
                _STAGED.remove(path)
                _delete(spark, path)

    try:
        yield keep_only
    finally:
        _BLOCK.reset(outer)


def remove_staged(spark: SparkSession) -> None:
    """Delete the tables this session has staged, for when all results that read them are written."""
    while _STAGED:
        _delete(spark, _STAGED.pop())


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scanned table with fewer splits than cores, spread over the cores.

    A small file is often a single row group and so a single busy task. A
    table of a split per core stays as it is: a shuffle of it costs more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def _fixed_bytes(kind: T.DataType) -> int | None:
    """Bytes of a value whose size its type tells, else None."""
    if isinstance(kind, T.StructType):
        sizes = [_fixed_bytes(f.dataType) for f in kind.fields]
        return None if None in sizes else 16 + sum(sizes)
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.VariantType)):
        return None
    return 16 if isinstance(kind, T.DecimalType) else 8


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """Size of a value in bytes, of every element and field of a nested one."""
    fixed = _fixed_bytes(kind)
    if fixed is not None:
        return F.lit(fixed).cast("long")
    if isinstance(kind, T.StructType):
        return sum((value_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.MapType):
        keys = value_bytes(F.map_keys(column), T.ArrayType(kind.keyType))
        return keys + value_bytes(F.map_values(column), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        element = _fixed_bytes(kind.elementType)
        if element is not None:
            size = F.size(column) * F.lit(element)
        else:
            size = F.aggregate(
                column, F.lit(0).cast("long"), lambda s, x: s + value_bytes(x, kind.elementType)
            )
        return F.coalesce(size, F.lit(0)) + F.lit(24).cast("long")
    text = F.to_json(column) if isinstance(kind, T.VariantType) else column
    return F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(24).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """Size of a row in bytes."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        fixed = _fixed_bytes(field.dataType)
        column = F.col(f"`{field.name}`")
        size = size + (value_bytes(column, field.dataType) if fixed is None else max(fixed, 16))
    return size


def table_bytes(df: DataFrame) -> int:
    """Size of a table in bytes, by a sum over its rows; the check before a broadcast."""
    return df.agg(F.sum(row_bytes(df)).alias("bytes")).first()["bytes"] or 0


def by_bytes(df: DataFrame, key: str, bytes_each: int = TASK_BYTES) -> DataFrame:
    """``df`` dealt out by key into tasks of about ``bytes_each``, however large it is."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-table_bytes(df) // bytes_each))
    return df.repartition(tasks, key)


def broadcast_within(df: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` marked for broadcast if its rows fit into ``budget`` bytes, else None."""
    return F.broadcast(df) if table_bytes(df) <= budget else None


def matching(
    big: DataFrame, wanted: DataFrame, key: str, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """The rows of ``big`` whose key is wanted; keys that fit are broadcast.

    With broadcast keys the big side is filtered where it is scanned.
    """
    keys = wanted.select(key).distinct()
    return big.join(broadcast_within(keys, budget) or keys, key, "left_semi")
