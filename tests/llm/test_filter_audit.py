"""The filter audit against a simulation of all orders, and its counting against plain sums."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from .conftest import LABELS, edge_texts, prose

from ctxrank.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """Each order applied to the documents, one filter after the other."""
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    docs = []
    for d, text, source in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and first[text] < d,
        }
        good, toxic = (any(l[0] == d and d is not None and l[i] == 1 for l in labels) for i in (1, 2))
        docs.append((source or "", {f for f in fails if fails[f]}, good, toxic))
    out = []
    for part in {d[0] for d in docs}:
        steps, removed_by = [], Counter()
        for order in permutations("ABCDE"):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                now = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                alone = sum(d[0] == part and d[1] == {f} for d in docs)
                late = sum(f in d[1] for d in gone)
                steps.append((part, "".join(order), step, len(left), len(now), late, alone, sum(d[2] for d in now), sum(d[3] for d in now), f))
                gone += now
                removed_by[f] += len(now)
        out += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return sorted(out)


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_audit(spark, tmp_path):
    rows = [(d, t, ["s", None, "", "t"][i % 4]) for i, (d, t) in enumerate(edge_texts())]
    rows += [(50 + i, prose(500 + i % 7, 230) + ["", " #", " AB CD EF"][i % 3], "t") for i in range(40)]
    rows += [(-3, "x " * 300, "s"), (95, "A|B", None), (96, "A|B", None), (97, "Same " * 199 + "Same", "s")]
    labels = [(d, i % 2, i % 3 == 0) for i, (d, _, _) in enumerate(rows) if i % 4] + [(50, 1, 0), (50, None, None), (None, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    docs = docs.withColumn("part", F.lit("p")).withColumn("fails", F.lit("f")).withColumn("digest", F.lit("d"))
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_empty_table(nothing, no_labels):
    docs = nothing.withColumn("source", F.lit("s"))
    assert filter_audit.audit(docs, no_labels).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000, 4099])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    want = [(int(((words >> np.uint32(i)) & 1).sum())) for i in range(32)]
    assert filter_audit.positional_popcount(words).tolist() == want


def test_buffers_are_added_up(spark, monkeypatch):
    rows = [("p" if i % 3 else "q", i % 32, i % 2 == 0, i % 5 == 0) for i in range(2000)]
    flagged = spark.createDataFrame(rows, "part string, fails int, is_good boolean, is_toxic boolean").repartition(4)
    monkeypatch.setattr(filter_audit, "BUFFER_WORDS", 64)
    for r in filter_audit.survivors(flagged).collect():
        mine = [x for x in rows if x[0] == r.part]
        for column, kept in (("survivors", mine), ("good", [x for x in mine if x[2]]), ("toxic", [x for x in mine if x[3]])):
            assert r[column] == [sum(not x[1] & s for x in kept) for s in range(32)]
