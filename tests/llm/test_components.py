"""Components of links, and what their rounds leave behind."""

from __future__ import annotations

import random

import pytest

from ctxrank import session
from ctxrank.llm import ngram_join
from ctxrank.llm.components import components


@pytest.mark.parametrize("links", [[], [(1, 0)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(30)], None])
def test_components_by_plain_union(spark, links):
    r = random.Random(2)
    links = [(r.randrange(90), r.randrange(90)) for _ in range(70)] if links is None else links
    group = {x: x for link in links for x in link}
    for a, b in links:
        low, high = sorted((group[a], group[b]))
        group = {x: low if g == high else g for x, g in group.items()}
    edges = spark.createDataFrame([*links, *links], "a long, b long")
    assert sorted(map(tuple, components(edges).select("a", "b").collect())) == sorted((x, g) for x, g in group.items() if x != g)


def test_rounds_leave_only_the_tables_of_the_result(spark):
    rows = [(i, " ".join(f"w{i // 4}x{j}" for j in range(60 - i % 4))) for i in range(40)]
    before = len(session._STAGED)
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(session._STAGED) - before <= 2
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i // 4 * 4 for i, _ in rows}
