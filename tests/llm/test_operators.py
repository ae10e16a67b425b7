"""Each operator on edge cases, against plain definitions and on empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from .conftest import ITEMS, edge_texts

from ctxrank.llm import chat, decision_list, decontamination, lines, neighbours, ngram_join, packing, repeats, secrets, urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(value: bytes | str) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def test_ngram_join(edges, nothing):
    rows = edge_texts()
    sets = []
    for _, text in rows:
        w = SPACE.findall((text or "").translate(FOLD))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    key = [-(1 << 63) if d is None else d for d, _ in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = sorted(
        (key[i], len(sets[i]), min(key[j] for j in range(len(rows)) if group[j] == group[i])) for i in range(len(rows))
    )
    real = lambda v: -(1 << 63) if v is None else v
    for budget in (0, 1 << 25):
        got = ngram_join.near_duplicates(edges, join_bytes=budget).collect()
        assert sorted((real(r[0]), r[1], real(r[2])) for r in got) == want
    assert ngram_join.near_duplicates(nothing).count() == 0
    kept = ngram_join.first_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3, 4, 5, 7, 8, 9, 40)) == [1, 2, 3, 4, 40, 40]
    assert ngram_join.first_of_each(nothing).count() == 0


def test_frequent_class_agrees_with_single_shingles(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in r.choice(120, r.integers(0, 4), replace=False):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    with_pairs = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()))
    monkeypatch.setattr(ngram_join, "MIN_COUNT", 10**6)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == with_pairs


@pytest.mark.parametrize("seed", [4, 5])
def test_crowds_near_the_threshold(spark, monkeypatch, seed):
    """Most of a crowd is settled before the last step, which still finds what is left."""
    r = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(150)]
    rows, sets = [], []
    for i in range(400):
        words = list(base)
        for at in r.choice(150, r.integers(0, 7), replace=False):
            words[at] = f"e{i if r.random() < 0.7 else r.integers(0, 3)}x{at}"
        words = words[: 150 - r.integers(0, 12)] if r.random() < 0.3 else words
        rows.append((i, " ".join(words)))
        sets.append({tuple(words[j : j + 4]) for j in range(len(words) - 3)})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    met, all_pairs = [], ngram_join._all_pairs

    def last_step(shared, percent):
        other = shared.where("own").selectExpr("sig", "sid as hub", "comp as hub_comp")
        met.append(shared.join(other, "sig").where("comp <> hub_comp").count())
        return all_pairs(shared, percent)

    monkeypatch.setattr(ngram_join, "_all_pairs", last_step)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {row["doc_id"]: row["component_id"] for row in ngram_join.near_duplicates(docs).collect()}
    assert got == dict(enumerate(group))
    assert met[0] < 50_000


def test_urls(spark):
    rules = [urls.site_rule("net/", "block"), urls.site_rule("example.net/en/", "allow"), urls.word_rule("casino")]
    pages = [
        (1, "http://a.NET/x?y"), (2, "http://b.example.net/en/z"), (3, None), (None, "no scheme"), (4, "http://a.net"),
        (5, "https://x.org/casino/1"), (5, "https://x.org/casino/1"), (6, "http://notexample.net/en/q#f"), (7, "http://x.org/casinos"),
    ]
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect())
    assert got == Counter([
        (1, "a.net", "/x", "net/", "block"), (2, "b.example.net", "/en/z", "example.net/en/", "allow"),
        (3, "", "", None, "allow"), (None, "", "", None, "allow"), (4, "a.net", "", None, "allow"),
        (5, "x.org", "/casino/1", None, "block"), (5, "x.org", "/casino/1", None, "block"),
        (6, "notexample.net", "/en/q", "net/", "block"), (7, "x.org", "/casinos", None, "allow"),
    ])
    assert urls.judge_urls(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("chunk", [2, 512])
def test_repeats(edges, nothing, chunk):
    rows = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in edge_texts()]
    seen: dict[bytes, list] = defaultdict(list)
    for i, (d, text) in enumerate(rows):
        for at in range(len(text) - 399):
            seen[text[at : at + 400]].append((d, at, i))
    want = []
    for i, (d, text) in enumerate(rows):
        cover = bytearray(len(text))
        for at in range(len(text) - 399):
            if len(seen[text[at : at + 400]]) > 1:
                cover[at : at + 400] = b"\1" * 400
        left = bytes(c for c, gone in zip(text, cover) if not gone)
        want.append((d, len(text), sum(cover), len([x for x in bytes(cover).split(b"\0") if x]), sha(left)))
    spans = repeats.repeated_spans(edges, chunk=chunk, join_bytes=0 if chunk == 2 else 1 << 25)
    got = repeats.without_repeats(edges, spans, keep_first=False).collect()
    real = lambda v: -(1 << 63) if v is None else v
    assert sorted((real(r.doc_id), r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in got) == sorted(want)
    assert repeats.without_repeats(nothing, repeats.repeated_spans(nothing)).count() == 0


def test_classifier(spark, edges, nothing, no_labels):
    labels = spark.createDataFrame([(20, 1, 0), (21, 1, 0), (31, 0, 0), (None, 0, 0), (22, None, 0)], no_labels.schema)
    scores = neighbours.score(edges, neighbours.fit(edges, labels)).collect()
    assert len(scores) == len(edge_texts()) and all(0 <= r.score <= 1 for r in scores)
    of = {r.doc_id: r.score for r in scores}
    assert of[31] < 0.5 < of[23] and of[1] == of[2]
    assert {r.score for r in neighbours.score(edges, neighbours.fit(edges, no_labels)).collect()} == {0.5}
    assert neighbours.score(nothing, neighbours.fit(nothing, labels)).count() == 0


def test_classifier_scores_do_not_depend_on_partitions(spark, no_labels):
    r = np.random.default_rng(6)
    texts = [" ".join(r.choice(["ab", "cd", "efg", "hij", "k"], 6)) for _ in range(300)]
    docs = spark.createDataFrame([(i, texts[i // 3]) for i in range(900)], "doc_id long, text string")
    # Copies with different labels are ties of labelled vectors.
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 900, 2)] + [(i, 1, 0) for i in range(1, 900, 4)], no_labels.schema)
    seen = []
    for n in (1, 7, 64):
        model = neighbours.fit(docs.repartition(n), labels)
        seen.append(sorted((x.doc_id, x.score) for x in neighbours.score(docs.repartition(n), model).collect()))
    assert seen[0] == seen[1] == seen[2]
    of = dict(seen[0])
    assert all(of[3 * i] == of[3 * i + 1] == of[3 * i + 2] for i in range(300))


def test_lines(edges, nothing):
    rows = [(-(1 << 63) if d is None else d, t) for d, t in edge_texts()]
    key = lambda line: line.strip(" \t\n\v\f\r").translate(FOLD)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    want = []
    for d, t in rows:
        parts = (t or "").split("\n")
        keep = [p for p in parts if len(key(p)) < 40 or len(holders[key(p)]) < 5 or max(holders[key(p)]) == d]
        want.append((d, len(parts), len(parts) - len(keep), "\n".join(keep)))
    assert any(w[2] for w in want)
    for budget in (0, 1 << 25):
        got = lines.without_lines(edges, lines.keep_bitmaps(edges), budget).collect()
        real = lambda v: -(1 << 63) if v is None else v
        assert sorted((real(r.row.doc_id), r.n_lines, r.n_dropped, r.kept_text or "") for r in got) == sorted(want)
    out = lines.dedup_lines(edges)
    assert out.columns == edges.columns and all(r.n_chars == len(r.text) for r in out.collect() if r.text)
    assert lines.dedup_lines(nothing).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", None), (1, 600, "user", "x"), (1, 600, "user", "x"), (None, None, None, "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    views = chat.perspectives(df)
    whole = {(r.conv_id, r.speaker): r for r in chat.dialogues(views).collect()}
    u = whole[1, "user"]
    other = "<|user name=bot|>\n<|end|>\n"
    own = lambda t: f"<|assistant|>\n{t}<|end|>\n"
    assert u.text == own("hi") + other + own("x") + own("x")
    assert [u.text[m.start : m.end] for m in u.masks] == [own("hi"), own("x"), own("x")]
    assert set(whole) == {(1, "user"), (1, "bot"), (None, "unknown")}
    assert chat.perspectives(df.limit(0)).count() == 0


def test_packing(edges, nothing):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for d, t in edge_texts():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    pieces = packing.pack(edges, TOKENIZER, 2, merge_partitions=2).toPandas()
    got, open_docs = Counter(), defaultdict(list)
    for r in pieces.sort_values("start").itertuples():
        open_docs[None if np.isnan(r.doc_id) else int(r.doc_id)].append(r)
    for d, rows in open_docs.items():
        if sum(w for (x, *_), w in want.items() if x == d) == 1:
            ids = b"".join(r.ids for r in rows)
            got[d, rows[0].doc_tokens, zlib.crc32(ids)] += 1
    assert got == Counter({k: v for k, v in want.items() if (k[0] is not None and k[0] not in (8, 40))})
    assert sum(len(i) for i in pieces.ids) == 4 * sum(k[1] * v for k, v in want.items())
    for _, rows in pieces.sort_values("offset").groupby("sequence_id"):
        sizes = rows.ids.map(len) // 4
        assert sizes.sum() <= 4096 and list(rows.offset) == list(sizes.cumsum() - sizes)
    assert packing.pack(nothing, TOKENIZER, 2).count() == 0


def test_secrets(spark, edges, nothing):
    key = "xK9fQ2LqPz8Rw3TnV7bY"
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(9, 20)))
    texts = [" ".join(r.choice([w, w.title(), w.upper(), f"{w}_id", str(r.randrange(10**9, 10**10))]) for w in (word() for _ in range(1500)))] * 3
    texts += [f"password: hunter22 and token = '{'04dbebab91ab85687d33' * 2}' AKIA{'A1B2' * 5}", f"🙂 {key} text", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.find_secrets(docs, secrets.train(docs)).collect()}
    assert [texts[3][s.start : s.stop] for s in found[3].base if s.kind == 2] == ["04dbebab91ab85687d33" * 2]
    assert [s.kind for s in found[3].base] == [0, 0, 2, 1]
    assert [texts[4][s.start : s.stop] for s in found[4].added] == [key]
    assert not found[0].added and not found[5].base and not found[5].added
    assert secrets.find_secrets(edges, secrets.train(edges)).count() == len(edge_texts())
    assert secrets.find_secrets(nothing, secrets.train(nothing)).count() == 0


def test_decontamination(spark, edges, nothing):
    rows = dict((d, t) for d, t in edge_texts() if d is not None)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    base = word.findall(rows[7])
    items = [(1, " ".join(base[10:40])), (2, "One"), (3, None), (4, ""), (5, "no such words here"), (None, " ".join(base[50:70])), (6, "中文 🙂")]
    bench = spark.createDataFrame(items, ITEMS)
    grams = [(i, tuple(w[p : p + min(13, len(w))])) for i, t in items if (w := word.findall((t or "").translate(FOLD))) for p in range(len(w) - min(13, len(w)) + 1)]
    want = {}
    for d, t in rows.items():
        w, hit, ids = word.findall((t or "").translate(FOLD)), set(), set()
        for i, g in grams:
            for p in range(len(w) - len(g) + 1):
                if w[p] == g[0] and tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    ids.add(i)
        want[d] = (len(w), len(hit), sorted(str(i) for i in ids if i is not None))
    for block in (1 << 22, 40):
        got = decontamination.contaminated(edges, bench, block_bytes=block).collect()
        assert len(got) == len(edge_texts())
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got if r.doc_id not in (None, 40)} == {d: w for d, w in want.items() if d != 40}
    left = decontamination.uncontaminated(edges, bench)
    assert left.columns == edges.columns and 7 not in {r.doc_id for r in left.collect()}
    assert decontamination.uncontaminated(nothing, bench).count() == 0
    assert decontamination.uncontaminated(edges, bench.limit(0)).count() == len(edge_texts())


def test_decontamination_by_other_windows(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words)
    docs = spark.createDataFrame([(1, "x " * 5 + item + " y"), (2, " ".join(words[:25])), (3, item.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], ITEMS)
    for window in (5, 13, 20, 41):
        found = {r.doc_id: r for r in decontamination.verbatim_matches(docs, bench, window=window).collect()}
        assert [(m.start, m.length, m.item_start) for m in found[1].matches] == [(5, 60, 0)]
        assert [(m.start, m.length) for m in found[2].matches] == ([(0, 25)] if window <= 25 else [])
        assert [m.length for m in found[3].matches] == [60]


def test_items_of_one_text_are_searched_once(spark):
    docs = spark.createDataFrame([(1, "the " * 2000), (2, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "the") for i in range(2000)] + [(None, "the")], ITEMS)
    found = {r.doc_id: r for r in decontamination.verbatim_matches(docs, bench).collect()}
    assert len(found[1].matches) == 2000 and not found[2].matches
    judged = {r.doc_id: r for r in decontamination.contaminated(docs, bench).collect()}
    assert judged[1]["items"] == sorted(str(i) for i in range(2000)) and judged[1].n_hit == 2000
    assert judged[2]["items"] == [] and not judged[2].contaminated


def test_quality_rules(spark, edges, nothing, no_labels):
    got = {r.doc_id: r for r in decision_list.judged(edges, []).collect()}
    for d, t in edge_texts():
        if d in (None, 40):
            continue
        w = SPACE.findall(t or "")
        often = Counter(zip(w, w[1:], w[2:]))
        cover = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if often[x] > 1 for j in range(3)}
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            again += bool(SPACE.search(line)) and line in seen
            seen.add(line)
        c = got[d].counts
        assert (c.n_words, c.word_chars, c.n_dup_lines, c.n_repeat_words) == (len(w), sum(map(len, w)), again, len(cover))
        assert c.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert got[d].kept == (len(w) >= 50 and 100 * len(cover) <= 50 * len(w))
    r = np.random.default_rng(0)
    values = r.random((600, len(decision_list.RATIOS)))
    bad = values[:, 2] > 0.8
    rules = decision_list.learn(values, bad)
    assert [c.statistic for rule in rules for c in rule] == ["symbols_per_word"]
    assert decision_list.learn(values, bad & False) == []
    assert decision_list.keep_good(edges, no_labels).columns == edges.columns
    assert decision_list.keep_good(nothing, no_labels).count() == 0


def test_secrets_of_other_forms_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ratios = secrets.train(docs)
    r = random.Random(9)
    keys = ["".join(r.choice(a) for _ in range(n)) for a in secrets.KEY_ALPHABETS for n in (20, 28, 40) for _ in range(15)]
    keys = [k for k in keys if not re.search(r"[0-9a-f]{24,}|AKIA", k)]
    rows = [(i, f"note {k} end") for i, k in enumerate(keys)]
    found = {x.doc_id: x.added for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ratios).collect()}
    assert len(keys) > 200 and sum([s.start for s in found[i]] == [5] for i in range(len(keys))) >= 0.9 * len(keys)
    assert secrets.find_secrets(docs, ratios).where("size(added) > 0").count() == 0
    # Names made of the corpus' own words are ordinary.
    words = sorted({w for x in docs.select("text").limit(300).collect() for w in re.findall(r"\b[a-z]{8,12}\b", x.text)})
    pairs = [r.sample(words, 2) for _ in range(200)]
    names = [n for a, b in pairs for n in (f"{a}_{b}", f"{a}-{b}", a + b.title(), (a + b).upper())]
    table = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    assert secrets.find_secrets(table, ratios).where("size(added) > 0").count() <= 0.02 * len(names)


def test_secrets_against_plain_definitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ratios = secrets.train(docs)
    r = random.Random(3)
    pieces = ["password: hunter22", "token='ab'", "api_key=Zz9-xK.3", "AKIA" + "A1" * 9, "AKIA12", "deadbeef" * 4, "feed" * 3, "🙂é", "plain words",
              "xK9fQ2LqPz8Rw3TnV7bYd1", "thisisanordinaryidentifier"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(60)] + ["", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [re.compile(secrets.ASSIGN.replace(r"\"", '"')), re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")]
    for x in secrets.find_secrets(table, ratios).collect():
        text = texts[x.doc_id] or ""
        base = [(m.start(), k, m.end()) for k, p in enumerate(kinds) for m in p.finditer(text) if k or len(m.group(2)) >= 6]
        assert [(s.start, s.kind, s.stop) for s in x.base] == sorted(base)
        added = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
            codes = [secrets.ALPHABET.index(c) for c in m.group()]
            score = sum(ratios[a * secrets.SIZE + b] for a, b in zip(codes, codes[1:]))
            free = all(m.end() <= b[0] or b[2] <= m.start() for b in base)
            if free and score >= max(secrets.MIN_RATIO, secrets.MIN_RATE * (len(codes) - 1)):
                added.append((m.start(), m.end()))
        assert [(s.start, s.stop) for s in x.added] == added
