"""Alignment of two tokenizers against whole-text tokenization, on hostile texts and cut at any byte."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from .conftest import SCHEMA, edge_texts

from ctxrank.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def hostile_texts() -> list[str]:
    r = random.Random(8)
    parts = [" ", "  ", "\n", "\t", "a", "the", "The", "'s", "é", "ß", "ñandú", "中", "🙂", "12", "!!", "-", " ", "　",
             "́", "​", "▁", "<|endoftext|>", "<s>", "<0x41>", "\x00", "\x1c", "\u0085", "ﬁ", "İ", "licence", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(120)]
    return texts + [" ".join(r.choice(parts) for _ in range(80)) for _ in range(40)] + ["x" * 5000, "a b " * 900, " " * 700]


def plain(texts: list[str | None]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups, by definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    entries = {i: e for e, i in json.load(open(PATHS[0], encoding="utf-8"))["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in texts:
        found.append([])
        if not text:
            continue
        tokens = [(i, bytes(byte_of[c] for c in entries[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, piece(i)) for i in b.encode(text)]
        if not b"".join(t for _, t in tokens) == b"".join(t for _, t in pieces) == (" " + text).encode():
            continue
        i = j = at_i = at_j = 0
        group_a, group_b = [], []
        while i < len(tokens) or j < len(pieces):
            if at_i <= at_j:
                at_i, _ = at_i + len(tokens[i][1]), group_a.append(tokens[i][0])
                i += 1
            else:
                at_j, _ = at_j + len(pieces[j][1]), group_b.append(pieces[j][0])
                j += 1
            if at_i == at_j:
                found[-1].append((group_a, group_b))
                counts[group_a[-1], group_b[-1]] += 1
                group_a, group_b = [], []
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    rows = []
    for groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links), text,
        ))
    return rows


@pytest.mark.parametrize("chunk, frequent", [(1 << 16, 1 << 20), (64, 100), (700, 0)])
def test_alignment(spark, chunk, frequent):
    rows = edge_texts() + list(enumerate(hostile_texts(), 100))
    want = Counter((d, *p) for (d, _), p in zip(rows, plain([t for _, t in rows])))
    assert sum(n for k, n in want.items() if not k[1]) > 5 and sum(n for k, n in want.items() if k[1]) > 60
    data = [(d, t, 0, "s", 1, "k", "w", "r") for d, t in rows]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    aligned = alignment.align(docs, *PATHS, chunk_bytes=chunk)
    got = alignment.with_pair_counts(aligned, alignment.vocabulary_size(PATHS[1]), frequent)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_fragments_compose_associatively():
    pair = alignment.Pair(*PATHS)
    text = "Unglaubliche Zusammenhänge, das ist heute sehr erfreulich: encyclopaedias!"
    a, b = (np.array(ids) for ids in pair.encode([text])[0])
    ends_a, ends_b = pair.size_a[a].cumsum(), pair.size_b[b].cumsum()
    whole = alignment.fragment(a, b, ends_a, ends_b)

    def part(low, high):
        in_a, in_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
        return alignment.fragment(a[in_a], b[in_b], ends_a[in_a], ends_b[in_b])

    same = lambda x, y: all((getattr(x, f) == getattr(y, f)).all() for f in ("a", "b", "cut_a", "cut_b"))
    n = len((" " + text).encode())
    for i in range(n):
        for j in range(i, n, 3):
            x, y, z = part(0, i), part(i, j), part(j, n)
            assert same((x + y) + z, whole) and same(x + (y + z), whole)
            closed = [*x.groups(), *(x + y + z).groups()]
            assert len(closed) >= len(list(x.groups()))
            if len(x.cut_a) and len(y.cut_a):
                joined = [g.tolist() for g in (x + y).groups().__next__()] if len(x.cut_a) == 1 else None
                if joined:
                    assert joined == [[*s, *p] for s, p in zip((g.tolist() for g in x.suffix()), (g.tolist() for g in y.prefix()))]
    assert same(alignment.EMPTY + whole, whole) and same(whole + alignment.EMPTY, whole)


def test_empty_table(nothing):
    got = alignment.with_pair_counts(alignment.align(nothing, *PATHS), 32000)
    assert got.count() == 0 and {"n_best", "count_sum", "groups"} <= set(got.columns)


def test_sha_of_groups_is_that_of_the_query(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(
        (d, *p[:6], hashlib.sha256(p[6].encode()).hexdigest() if p[6] else "") for (d, _), p in zip(docs, plain([t for _, t in docs]))
    )
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = entry.queries()["op11_token_alignment"](spark, folder)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want
