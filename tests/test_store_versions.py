"""Versions of a store: overlapping fills, upserts, pruning, lookups by key range, readers in between."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ctxrank.operators.models import make_test_encoder
from ctxrank.plans.end_to_end import embed
from ctxrank.sources.store import Store, store_sizes, vector_store

SCHEMA = "k STRING, pos INT, text STRING, part STRING"


def store(tmp_path, **options) -> Store:
    return Store(str(tmp_path / "s"), SCHEMA, "k", {"part": "a/b c"}, **options)


def rows(spark, keys, value, n=1):
    data = [(k, i, value) for k in keys for i in range(n)]
    return spark.createDataFrame(data, "k STRING, pos INT, text STRING")


def held(df):
    return Counter(tuple(r) for r in df.select("k", "pos", "text").collect())


def test_overlapping_fills_give_each_key_once(spark, tmp_path):
    s = store(tmp_path)
    wanted = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k STRING")

    def slow(missing):
        # Another writer fills two of the keys while these are computed.
        s.fill(wanted("b", "c"), lambda m: rows(spark, [r.k for r in m.collect()], "fast", 3))
        return rows(spark, sorted(r.k for r in missing.collect()), "slow", 2)

    found = s.fill(wanted("a", "b", "d"), slow)
    assert held(found) == held(rows(spark, ["a", "d"], "slow", 2).union(rows(spark, ["b"], "fast", 3)))
    assert held(s.read(spark)) == held(rows(spark, ["a", "d"], "slow", 2).union(rows(spark, ["b", "c"], "fast", 3)))
    assert s.version(spark).number == 2 and s.count(spark) == 10


def test_append_keeps_what_is_stored(spark, tmp_path):
    s = store(tmp_path)
    s.append(rows(spark, "ab", "old"))
    s.append(rows(spark, "bc", "new"))
    s.append(rows(spark, "bc", "newer"))
    assert held(s.read(spark)) == {("a", 0, "old"): 1, ("b", 0, "old"): 1, ("c", 0, "new"): 1}
    assert s.version(spark).number == 2


def test_a_reader_sees_one_version(spark, tmp_path):
    s = store(tmp_path)
    s.append(rows(spark, "abcd", "old", 2))
    before, version = s.read(spark), s.version(spark)
    s.upsert(rows(spark, "be", "new", 1))
    s.prune(spark.createDataFrame([("b",), ("c",), ("e",), ("z",)], "k STRING"))
    assert held(before) == held(s.read(spark, version)) == held(rows(spark, "abcd", "old", 2))
    assert held(s.read(spark)) == held(rows(spark, "be", "new").union(rows(spark, "c", "old", 2)))
    s.compact(spark)
    assert held(s.read(spark)) == held(rows(spark, "be", "new").union(rows(spark, "c", "old", 2)))
    s.expire(spark)
    assert len(list((tmp_path / "s").glob("*/data/*"))) == 1
    assert held(s.read(spark)) == held(rows(spark, "be", "new").union(rows(spark, "c", "old", 2)))
    s.prune(spark.createDataFrame([], "k STRING"))
    assert s.read(spark).count() == 0 and s.count(spark) == 0


def test_a_change_made_meanwhile_is_taken_in(spark, tmp_path, monkeypatch):
    s = store(tmp_path)
    s.append(rows(spark, "abc", "old"))
    write, fired = Store._write, []

    def interrupted(self, data):
        if not fired:
            fired.append(1)
            s.upsert(rows(spark, "bd", "other"))
        return write(self, data)

    monkeypatch.setattr(Store, "_write", interrupted)
    s.upsert(rows(spark, "ab", "mine"))
    assert held(s.read(spark)) == held(rows(spark, "ab", "mine").union(rows(spark, "c", "old")).union(rows(spark, "d", "other")))


@pytest.mark.parametrize("kind", ["range", "fill"])
def test_lookups_open_few_files(spark, tmp_path, kind):
    s = store(tmp_path, rows_per_file=50)
    key = F.sha2(F.col("id").cast("string"), 256)
    made = lambda low, high: spark.range(low, high).select(key.alias("k"), F.lit(0).alias("pos"), F.lit("v").alias("text"))
    if kind == "range":
        s.append(made(0, 10_000))
        keys = [r.k for r in s.read(spark).orderBy("k").limit(100).collect()]
    else:
        # Keys of one fill are anywhere in the key order, and in no file of another fill.
        s = store(tmp_path, rows_per_file=1000)
        for i in range(15):
            s.append(made(100 * i, 100 * (i + 1)))
        keys = [r.k for r in made(705, 720).collect()]
    wanted = spark.createDataFrame([(k,) for k in keys] + [("zz",), (None,)], "k STRING")
    version = s.version(spark)
    opened = s.files_with(wanted, version)
    assert len(version.files) >= 15 and len(opened) < 0.1 * len(version.files)
    assert sorted(r.k for r in s.lookup(wanted).collect()) == sorted(keys)
    assert s.files_with(wanted.where("k = 'zz'"), version) == frozenset()


def test_sizes_count_keys_that_two_files_share(spark, tmp_path):
    s = store(tmp_path, rows_per_file=3)
    s.append(rows(spark, "abcd", "x", 4))
    Store(s.path, SCHEMA, "k", {"part": "other"}).append(rows(spark, "ab", "y"))
    found = {r.part: r["items"] for r in store_sizes(spark, s.path, SCHEMA, "k").collect()}
    assert found == {"a/b c": 4, "other": 2}
    assert store_sizes(spark, str(tmp_path / "none"), SCHEMA, "k").count() == 0


def test_embed_overwrites_or_only_reads(spark, tmp_path):
    s = vector_store(str(tmp_path / "v"), "counts", "t")
    texts = spark.createDataFrame([("a b",), ("c",)], "text STRING")
    first = embed(texts, s, lambda: lambda ts: [[0.0] * 3 for _ in ts])
    assert {tuple(r.vec) for r in first.collect()} == {(0.0,) * 3}
    assert {tuple(r.vec) for r in embed(texts, s, make_test_encoder).collect()} == {(0.0,) * 3}
    assert all(sum(r.vec) > 0 for r in embed(texts, s, make_test_encoder, mode="overwrite").collect())
    assert all(sum(r.vec) > 0 for r in embed(texts, s, None, mode="stored").collect())
    with pytest.raises(LookupError):
        embed(spark.createDataFrame([("d",)], "text STRING"), s, None, mode="stored")
    with pytest.raises(ValueError):
        embed(texts, s, None, mode="other")
