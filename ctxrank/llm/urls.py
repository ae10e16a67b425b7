"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens it
cannot match without. Token counts of all urls tell which of them is rarest; a
url's tokens fetch the rules stored under them, and only those run their
expression. Rules without a literal token run on every url.

A null url, or one without ``://``, has an empty host and path and no tokens.
Null ids and repeated rows pass through, one result a row; of equally long rules
that match, the alphabetically first wins. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[A-Za-z0-9]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# The rule set travels to every task.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; each of ``tokens`` stands in every text it matches."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def site_rule(site: str, verdict: str) -> Rule:
    """A rule for ``host/path``: that host and its subdomains, paths that start with the path."""
    host, slash, path = site.partition("/")
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host)}" + (re.escape(slash + path) if slash else r"(?:/|\Z)")
    tokens = tuple(dict.fromkeys(TOKEN.findall(host)))
    return Rule(site, verdict, pattern, tokens, len(site))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule for one word anywhere in host or path; any site rule goes before it."""
    return Rule(f"*{word}*", verdict, rf"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", tuple(TOKEN.findall(word)), 0)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(FOLD), re.match(r"[^?#]*", rest[len(host) :]).group()


def url_tokens(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(host)) | set(TOKEN.findall(path))


def _urls(batch: pa.RecordBatch, at: int) -> Iterator[tuple[str, str]]:
    return map(split_url, batch.column(at).to_pylist())


def token_counts(pages: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many urls each token of the rules stands, over all pages."""
    wanted = sorted({t for r in rules for t in r.tokens})
    place = {t: i for i, t in enumerate(wanted)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for host, path in _urls(batch, 0):
                for token in url_tokens(host, path):
                    if token in place:
                        seen[place[token]] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([wanted[i] for i in some], pa.string()), pa.array(seen[some])], names=["token", "n"]
        )

    counted = pages.select("url").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {row["token"]: row["n"] for row in counted.collect()}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token; under the empty string those without one."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(rarest, []).append(rule)
    return index


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_tried) per page.

    Of the rules that match, the one with the highest rank decides; ``rule`` is its
    name if it is a site rule, else null. ``n_tried`` counts the expressions run.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    index = rule_index(rules, token_counts(pages, rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, re.Pattern] = {}
        for batch in batches:
            out = []
            for host, path in _urls(batch, 1):
                best, tried = None, 0
                for token in {"", *url_tokens(host, path)}:
                    for rule in index.get(token, ()):
                        if rule.pattern not in ready:
                            ready[rule.pattern] = re.compile(rule.pattern)
                        tried += 1
                        if ready[rule.pattern].search(host + path) and (
                            best is None or (-rule.rank, rule.name) < (-best.rank, best.name)
                        ):
                            best = rule
                name = best.name if best and best.rank else None
                out.append((host, path, name, best.verdict if best else default, tried))
            columns = [list(c) for c in zip(*out)] or [[], [], [], [], []]
            kinds = [pa.string()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["page_id", "host", "path", "rule", "verdict", "n_tried"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(
        judge, f"page_id {kind}, host string, path string, rule string, verdict string, n_tried long"
    )
