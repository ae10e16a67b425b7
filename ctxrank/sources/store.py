"""Content-keyed stores of generated text and vectors: immutable parquet files and versions of their list.

A partition of a store is a folder. Every change writes new files, clustered by key, and a
table with each file's key range and Bloom filter; then one small text file, the next
version, names all files that are now live. A reader takes one version, so it never sees
half a change, and a lookup opens only the files that may hold its keys. A writer that
finds its version number taken looks at what the other one added and tries again, so
that of overlapping fills each key keeps the rows of the first to finish.

Repeated runs pay for no model call twice: a fill computes only what the store lacks.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxrank.session import CODEC, broadcast_within, matching, new_folder, stage, table_bytes

GENERATED = (
    "prompt_key STRING, pos INT, text STRING,"
    " kind STRING, model STRING, topic STRING, temperature DOUBLE, n INT"
)
VECTORS = "text_key STRING, vec ARRAY<DOUBLE>, encoder STRING, topic STRING"

# A lookup of more keys than this reads every file.
LOOKUP_BYTES = 32 << 20
# Fewer files than this are read without looking at their filters.
FEW_FILES = 8
# Rows of fewer bytes are written as one file.
SMALL_BYTES = 32 << 20
BLOOM_HASHES = 8
BLOOM_BITS_PER_KEY = 16


def overlay(winner: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All of ``winner``, and of ``other`` the rows whose key it lacks."""
    return winner.unionByName(missing(other, winner, key))


def missing(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The wanted rows whose key is not held.

    Wanted keys that fit are broadcast, so of a large held side only the keys
    in question are shuffled.
    """
    keys = broadcast_within(wanted.select(key).distinct())
    held = held.select(key)
    if keys is not None:
        held = held.join(keys, key, "left_semi")
    return wanted.join(held.distinct(), key, "left_anti")


def prune(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The stored rows whose key is still referenced."""
    return matching(stored, keys, key)


def lookup(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The stored rows of the wanted keys."""
    return matching(stored, wanted, key)


def store_name(model: str, topic: str, temperature: float, n: int) -> str:
    """Readable name of one store partition; the defaults go without saying."""
    name = f"{model.split('/')[-1]}_{topic}"
    # Fixed value: the default temperature is 0.1, with one completion.
    return name if (temperature, n) == (0.1, 1) else f"{name}_temperature_{temperature}_n_{n}"


class _Files:
    """The few file system calls a version needs, by the session's own Hadoop client."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._hadoop.Path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def matching(self, pattern: str) -> list[str]:
        return [s.getPath().toString() for s in self._fs.globStatus(self._hadoop.Path(pattern)) or []]

    def read(self, path: str) -> str:
        stream = self._fs.open(self._hadoop.Path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file whole, by renaming it into place; False if the name is taken."""
        draft = f"{path}-{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self._hadoop.Path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        source, target = (self._fs.makeQualified(self._hadoop.Path(p)) for p in (draft, path))
        context = self._hadoop.FileContext.getFileContext(source.toUri(), self._fs.getConf())
        try:
            context.rename(source, target, self._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception as error:
            self.remove(draft)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._hadoop.Path(path)).getLength()

    def remove(self, path: str) -> None:
        self._fs.delete(self._hadoop.Path(path), True)


@dataclass(frozen=True)
class Version:
    """One state of a partition: its number and its live files, as ``folder/file``."""

    number: int
    files: frozenset[str]

    def folders(self) -> list[str]:
        return sorted({f.split("/")[0] for f in self.files})


@dataclass(frozen=True)
class Store:
    """One partition of a store: a folder, a schema and the partition's values."""

    path: str
    schema: str
    key: str
    partition: dict[str, str | float | int]
    rows_per_file: int = 1_000_000

    @property
    def folder(self) -> str:
        return "/".join([self.path, *(f"{c}={quote(str(v), safe='')}" for c, v in self.partition.items())])

    # --- versions ----------------------------------------------------------

    def version(self, spark: SparkSession, number: int | None = None) -> Version:
        """The newest version, or the one with that number; version 0 is the empty store."""
        files = _Files(spark, self.path)
        if number is None:
            numbers = [int(n) for n in files.names(f"{self.folder}/versions") if n.isdigit()]
            number = max(numbers, default=0)
        if number == 0:
            return Version(0, frozenset())
        lines = files.read(f"{self.folder}/versions/{number:09d}").split("\n")
        return Version(number, frozenset(line for line in lines if line))

    def _publish(self, spark: SparkSession, base: Version, files: Iterable[str]) -> bool:
        path = f"{self.folder}/versions/{base.number + 1:09d}"
        return _Files(spark, self.path).publish(path, "\n".join(sorted(files)))

    def _schema(self, spark: SparkSession) -> T.StructType:
        return spark.createDataFrame([], self.schema).drop(*self.partition).schema

    def _rows(self, spark: SparkSession, files: Iterable[str]) -> DataFrame:
        schema, paths = self._schema(spark), [f"{self.folder}/data/{f}" for f in sorted(files)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> list[str]:
        """Write rows as files clustered by key, and the table of their ranges and filters.

        The rows are staged, as clustering reads them twice.
        """
        spark, folder = rows.sparkSession, uuid.uuid4().hex
        schema, draft = self._schema(spark), new_folder(spark, "rows")
        rows.select(*schema.names).write.option("compression", CODEC).parquet(draft)
        rows = spark.read.schema(schema).parquet(draft)
        small = _Files(spark, draft).size(draft) < SMALL_BYTES
        rows = rows.coalesce(1) if small else rows.repartitionByRange(self.key)
        path, files = f"{self.folder}/data/{folder}", f"{self.folder}/files/{folder}"
        rows = rows.sortWithinPartitions(self.key).write.option("maxRecordsPerFile", self.rows_per_file)
        rows.option("compression", CODEC).parquet(path)
        described(spark.read.schema(schema).parquet(path), self.key).write.parquet(files)
        described_files = spark.read.schema(_description(schema, self.key)).parquet(files)
        return [f"{folder}/{r['file']}" for r in described_files.select("file").collect()]

    # --- reading -----------------------------------------------------------

    def read(self, spark: SparkSession, version: Version | None = None) -> DataFrame:
        """The stored rows of the newest or a given version, without the partition columns."""
        return self._rows(spark, (version or self.version(spark)).files)

    def files_with(self, keys: DataFrame, version: Version) -> frozenset[str]:
        """The live files that may hold one of the keys, by their ranges and Bloom filters."""
        if len(version.files) <= FEW_FILES:
            return version.files
        spark = keys.sparkSession
        wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        if table_bytes(wanted) > LOOKUP_BYTES:
            return version.files
        table = wanted.select(self.key, _hash(self.key)).orderBy(self.key).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((table.column(0).to_pylist(), table.column(1).to_numpy()))
        found = self._described(spark, version).mapInArrow(_may_hold(shared), "path STRING")
        return version.files & {r["path"] for r in found.collect()}

    def _described(self, spark: SparkSession, version: Version) -> DataFrame:
        """The live files of a version with their description, and ``path`` as ``folder/file``."""
        schema = _description(self._schema(spark), self.key)
        if not version.files:
            return spark.createDataFrame([], schema).withColumn("path", F.col("file"))
        tables = spark.read.schema(schema).parquet(*[f"{self.folder}/files/{f}" for f in version.folders()])
        own = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        live = spark.createDataFrame([(f,) for f in sorted(version.files)], "path STRING")
        return tables.withColumn("path", F.concat_ws("/", own, "file")).join(F.broadcast(live), "path", "left_semi")

    def lookup(self, wanted: DataFrame, version: Version | None = None) -> DataFrame:
        """The stored rows of the wanted keys."""
        spark = wanted.sparkSession
        version = version or self.version(spark)
        return lookup(wanted, self._rows(spark, self.files_with(wanted, version)), self.key)

    def require(self, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted keys; fails if one is not stored."""
        wanted = stage(wanted)
        found = self.lookup(wanted)
        if not missing(wanted, found, self.key).isEmpty():
            raise LookupError(f"keys without a row in {self.path}")
        return found

    def count(self, spark: SparkSession) -> int:
        """Number of stored rows, by the tables of files alone."""
        return self._described(spark, self.version(spark)).agg(F.sum("n_rows")).first()[0] or 0

    # --- writing -----------------------------------------------------------

    def append(self, rows: DataFrame) -> None:
        """Add the rows whose key the store lacks; stored rows win."""
        base = self.version(rows.sparkSession)
        if base.files:
            rows = stage(rows)
            rows = missing(rows, self.lookup(rows, base), self.key)
        self._insert(rows, base)

    def fill(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Compute and store what the wanted keys lack; return all their rows.

        The wanted rows are staged, since they are compared with the store
        before and after; the computed ones are written once, before anything else.
        """
        wanted = stage(wanted)
        base = self.version(wanted.sparkSession)
        lacking = missing(wanted, self.lookup(wanted, base), self.key) if base.files else wanted
        self._insert(compute(lacking), base)
        return self.lookup(wanted)

    def _insert(self, rows: DataFrame, base: Version) -> None:
        """Publish rows of keys that ``base`` lacks, without those that other writers have added since."""
        spark = rows.sparkSession
        while True:
            files = self._write(rows)
            if not files or self._publish(spark, base, base.files | set(files)):
                return
            # Another attempt starts from what is written, so nothing is computed again.
            now = self.version(spark)
            rows = missing(self._rows(spark, files), self._rows(spark, now.files - base.files), self.key)
            base = now

    def _replace(self, spark: SparkSession, change: Callable[[Version], tuple[Iterable[str], DataFrame | None]]) -> None:
        """Publish a change of files, made again if another writer was faster.

        ``change`` gives for a version the files that go and the rows that come.
        """
        while True:
            now = self.version(spark)
            gone, rows = change(now)
            files = self._write(rows) if rows is not None else []
            if not files and not set(gone):
                return
            if self._publish(spark, now, (now.files - set(gone)) | set(files)):
                return

    def upsert(self, rows: DataFrame) -> None:
        """Replace the rows of these keys; only files that may hold one are written again."""
        rows = stage(rows)

        def change(now: Version) -> tuple[Iterable[str], DataFrame]:
            touched = self.files_with(rows, now)
            old = self._rows(rows.sparkSession, touched)
            return touched, overlay(rows.select(*old.columns), old, self.key)

        self._replace(rows.sparkSession, change)

    def refill(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Compute all wanted keys again, replace what is stored of them, return all their rows."""
        wanted = stage(wanted)
        self.upsert(compute(wanted))
        return self.lookup(wanted)

    def prune(self, keys: DataFrame) -> None:
        """Keep the rows of these keys only; files that lose nothing stay as they are."""
        keys = stage(keys.select(self.key).distinct())
        spark = keys.sparkSession

        def change(now: Version) -> tuple[Iterable[str], DataFrame | None]:
            if not now.files:
                return (), None
            rows = self._rows(spark, now.files).select(self.key, _file_path().alias("path"))
            kept = lookup(keys, rows, self.key).groupBy("path").agg(F.count("*").alias("kept"))
            sizes = self._described(spark, now).select("path", "n_rows")
            losing = sizes.join(kept, "path", "left").where("coalesce(kept, 0) < n_rows").collect()
            partly = [r["path"] for r in losing if r["kept"]]
            rest = lookup(keys, self._rows(spark, partly), self.key) if partly else None
            return [r["path"] for r in losing], rest

        self._replace(spark, change)

    def compact(self, spark: SparkSession) -> None:
        """Write all rows again in files clustered by key, as after many small fills."""
        self._replace(spark, lambda now: (now.files, self._rows(spark, now.files)) if now.files else ((), None))

    def expire(self, spark: SparkSession, keep: int = 1) -> None:
        """Forget all but the newest versions, and the files that none of those names.

        For when nobody reads an older version or writes a new one.
        """
        files = _Files(spark, self.path)
        numbers = sorted(int(n) for n in files.names(f"{self.folder}/versions") if n.isdigit())
        live = {f for n in numbers[-keep:] for f in self.version(spark, n).folders()}
        for number in numbers[:-keep]:
            files.remove(f"{self.folder}/versions/{number:09d}")
        for folder in set(files.names(f"{self.folder}/data")) - live:
            files.remove(f"{self.folder}/data/{folder}")
            files.remove(f"{self.folder}/files/{folder}")


def _hash(key: str) -> Column:
    return F.xxhash64(key).alias("hash")


def _file_path() -> Column:
    """``folder/file`` of the data file a row comes from."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def _description(schema: T.StructType, key: str) -> T.StructType:
    kind = schema[key].dataType
    described = T.StructType().add("file", T.StringType()).add("low", kind).add("high", kind)
    return described.add("n_rows", T.LongType()).add("n_keys", T.LongType()).add("bloom", T.BinaryType())


def _bits(hashes, size: int):
    """The bits of each hash in a filter of ``size`` bits, by double hashing."""
    import numpy as np

    hashes = hashes.view(np.uint64)
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(size) for i in range(BLOOM_HASHES)], 1).astype(np.int64)


def described(rows: DataFrame, key: str) -> DataFrame:
    """Per file its key range, numbers of rows and keys, and a Bloom filter of its keys."""
    schema = _description(rows.schema, key)
    keys = rows.select(F.col("_metadata.file_name").alias("file"), key)
    sizes = keys.groupBy("file").agg(
        F.min(key).alias("low"),
        F.max(key).alias("high"),
        F.count("*").alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
        F.collect_set(F.when(F.col(key).isNotNull(), F.xxhash64(key))).alias("hashes"),
    )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            filters, lists = [], batch.column(5)
            for i in range(batch.num_rows):
                hashes = lists[i].values.to_numpy()
                size = 64 * (len(hashes) * BLOOM_BITS_PER_KEY // 64 + 1)
                flags = np.zeros(size, np.uint8)
                flags[_bits(hashes, size).ravel()] = 1
                filters.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(filters, pa.binary())], names=schema.names)

    return sizes.mapInArrow(run, schema)


def _may_hold(shared) -> Callable[[Iterator], Iterator]:
    """Arrow step: the paths of described files that may hold one of the shared sorted keys."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys, hashes = shared.value
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "low", "high", "bloom")]
            found = []
            for path, low, high, bloom in zip(*columns):
                if low is not None:
                    flags = np.unpackbits(np.frombuffer(bloom, np.uint8))
                    mine = hashes[bisect_left(keys, low) : bisect_right(keys, high)]
                    if flags[_bits(mine, len(flags))].all(axis=1).any():
                        found.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    return run


def store_sizes(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Number of distinct keys in each partition of a store, by the tables of files alone.

    Files of one write follow each other by key, so a key that two of them share
    is the last of one and the first of the next.
    """
    whole = spark.createDataFrame([], schema)
    columns = [f for f in whole.schema.fields if f.name not in (key, "pos", "text", "vec")]
    rows = []
    for folder in _Files(spark, path).matching(f"{path}{'/*=*' * len(columns)}"):
        values = [unquote(part.split("=", 1)[1]) for part in folder.split("/")[-len(columns) :]]
        store = Store(path, schema, key, dict(zip((c.name for c in columns), values)))
        rows += [(folder, *values, f) for f in store.version(spark).files]
    named = ", ".join(f"`{c.name}` STRING" for c in columns)
    live = spark.createDataFrame(rows, f"folder STRING, {named}, path STRING")
    partition = [F.col(c.name).cast(c.dataType).alias(c.name) for c in columns]
    if not rows:
        return live.select(*partition, F.lit(0).cast("long").alias("items"))
    folders = sorted({f"{r[0]}/files/{r[-1].split('/')[0]}" for r in rows})
    tables = spark.read.schema(_description(whole.schema, key)).parquet(*folders)
    place = F.split(F.col("_metadata.file_path"), "/")
    tables = tables.select("file", "low", "high", "n_keys", F.element_at(place, -2).alias("write"))
    tables = tables.withColumn("path", F.concat_ws("/", "write", "file"))
    before = F.lag("high").over(Window.partitionBy("write").orderBy("low", "high"))
    shared = F.when(before == F.col("low"), 1).otherwise(0)
    found = tables.withColumn("shared", shared).join(F.broadcast(live), "path")
    return found.groupBy(*partition).agg((F.sum("n_keys") - F.sum("shared")).alias("items"))


def read_precomputed(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"prompt": ..., "texts": [...]}`` -> ``(prompt_key, pos, text)``."""
    lines = spark.read.schema("prompt STRING, texts ARRAY<STRING>").json(path)
    return lines.select(F.sha2("prompt", 256).alias("prompt_key"), F.posexplode("texts").alias("pos", "text"))


def generated_store(
    path: str, kind: str, model: str, topic: str, temperature: float = 0.1, n: int = 1
) -> Store:
    """Store of parsed questions or passages, as ``kind`` says.

    A prompt whose completion held none has no row, so it is asked again.
    """
    partition = {"kind": kind, "model": model, "topic": topic, "temperature": temperature, "n": n}
    return Store(path, GENERATED, "prompt_key", partition)


def vector_store(path: str, encoder: str, topic: str) -> Store:
    """Store of text vectors."""
    return Store(path, VECTORS, "text_key", {"encoder": encoder, "topic": topic})
