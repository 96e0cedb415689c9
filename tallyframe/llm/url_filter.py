"""URL filters: host and path rules, then a weighted vocabulary over the URL.

One Aho-Corasick automaton over the vocabulary reads each URL once. A hit
counts only between boundaries: the neighbouring characters must not be
ASCII letters (so "sussex" holds no "sex"). One strict term, or different
soft terms whose weights add up to `soft_limit`, rejects a URL that no rule
decides. With the default weights those are two plain terms, three mild ones,
or more of the words that honest addresses hold too.

Rules are (host, path, verdict). A rule fits its host and all subdomains, if
the path starts with the rule's; the longest rule wins, by host labels first,
then by path.

Defined results: a null URL, or one without "://", has an empty host and
path, fits no rule, and is judged by the vocabulary on what there is (null:
allowed). URLs of any length are read once, as a whole. Of rules alike in host
and path the first counts; rules with a null in them are none. Repeated rows
are judged alike, an empty table stays empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm.url_terms import SOFT_TERMS, STRICT_TERMS

#: Fixed by contract: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class UrlRules:
    rules: tuple[tuple[str, str, str], ...] = RULES
    strict: tuple[str, ...] = STRICT_TERMS
    soft: dict[str, int] = field(default_factory=lambda: dict(SOFT_TERMS))
    soft_limit: int = 12


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


class UrlJudge:
    def __init__(self, rules: UrlRules):
        import ahocorasick

        self.soft_limit = rules.soft_limit
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules.rules:
            if None in (host, path, verdict):
                continue
            self.by_host.setdefault(host, []).append((path, verdict))
        for found in self.by_host.values():
            found.sort(key=lambda r: -len(r[0]))
        self.automaton = ahocorasick.Automaton()
        for term, weight in rules.soft.items():
            self.automaton.add_word(term, (len(term), term, weight))
        for term in rules.strict:
            self.automaton.add_word(term, (len(term), term, None))
        self.empty = not (rules.soft or rules.strict)
        if not self.empty:
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        labels = host.split(".")
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    return suffix + start, verdict
        return None, None

    def terms(self, url: str) -> tuple[int, int, int]:
        """How many different strict and soft terms there are, between boundaries, percent-escapes decoded, and the
        weight of the soft ones."""
        text = (unquote_to_bytes(url).decode("utf-8", "replace") if "%" in url else url).translate(_LOWER)
        strict: set[str] = set()
        soft: dict[str, int] = {}
        if self.empty:
            return 0, 0, 0
        for end, (n, term, weight) in self.automaton.iter(text):
            before, after = text[end - n] if end >= n else "", text[end + 1 : end + 2]
            if "a" <= before <= "z" or "a" <= after <= "z":
                continue
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
        return len(strict), len(soft), sum(soft.values())

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int, int]:
        host, path = split_url(url)
        rule, verdict = self.rule(host, path) if host or path else (None, None)
        strict, soft, weight = self.terms(url or "")
        return host, path, rule, verdict or ("block" if strict or weight >= self.soft_limit else "allow"), strict, soft, weight


def judge_urls(pages: DataFrame, rules: UrlRules | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, strict_terms, soft_terms, soft_weight."""
    rules = rules or UrlRules()
    kind = pages.schema[key].dataType.simpleString()
    names = [key, "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "soft_weight"]

    def run(batches):
        judge = UrlJudge(rules).judge
        for batch in batches:
            rows = [judge(u) for u in batch.column(url).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()] * 3, strict=True))], names)

    return pages.select(key, url).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, strict_terms long, soft_terms long, soft_weight long")
