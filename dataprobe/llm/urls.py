"""URL filter: a trie over reversed host labels and path segments, with longest match."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.common import row_column, with_new_columns

#: Rules in one trie. More rules are dealt to several tries, and each row keeps the longest match of all.
RULES_PER_TRIE = 200_000


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    next: dict[str, _Node] = field(default_factory=dict)
    paths: _Node | None = None
    #: Rules that end here: ``(unfinished last segment, rank, rule)``.
    ends: list[tuple[str, tuple, Rule]] = field(default_factory=list)


class RuleTrie:
    """Host labels from the right, then path segments. A rule's last path segment may be the start of a
    longer one, so it is kept in the list of its node and compared as a prefix.

    The longest match wins: more host labels first, then the longer path; of equal rules block wins.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root = _Node()
        for rule in rules:
            labels = rule.host.split(".") if rule.host else []
            node = self.root
            for label in reversed(labels):
                node = node.next.setdefault(label, _Node())
            at = node.paths = node.paths or _Node()
            *whole, last = rule.path.split("/")
            for segment in whole:
                at = at.next.setdefault(segment, _Node())
            at.ends.append((last, (len(labels), len(rule.path), rule.verdict == "block"), rule))

    def match(self, host: str, path: str) -> tuple[tuple, Rule] | None:
        best = None
        node: _Node | None = self.root
        labels = host.split(".") if host else []
        segments = path.split("/")
        for label in [None, *reversed(labels)]:
            if label is not None:
                node = node.next.get(label)
                if node is None:
                    break
            at = node.paths
            for segment in segments:
                if at is None:
                    break
                for last, rank, rule in at.ends:
                    if segment.startswith(last) and (best is None or rank > best[0]):
                        best = rank, rule
                at = at.next.get(segment)
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "#?":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow",
                rules_per_trie: int = RULES_PER_TRIE) -> DataFrame:
    """``pages`` with host, path, rule (``host`` + ``path`` of the longest match, or null) and verdict.

    Every row gives one row: a null url, or one without ``://``, has an empty host and path. ``default`` is
    the verdict without a matching rule. Columns of ``pages`` that have a new column's name are replaced.
    Tries are sent with the task. Each holds at most ``rules_per_trie`` rules; with more rules the
    urls pass one trie after another, so a task holds one of them at a time.
    """
    blocks = [list(rules[i:i + rules_per_trie]) for i in range(0, len(rules), rules_per_trie)] or [[]]
    parts = [_judge(block)(F.col("url")) for block in blocks]
    judged = pages.select(row_column(pages).alias("row"), F.col(f"`{url}`").alias("url")).select(
        "row", F.array(*parts).alias("found"))
    best = F.array_max(F.transform("found", lambda x: x["best"]))
    verdict = F.when(best["rule"].isNull(), F.lit(default)).when(best["block"], "block").otherwise("allow")
    return judged.select(*with_new_columns(
        pages.columns, "row", host=F.col("found")[0]["host"], path=F.col("found")[0]["path"],
        rule=best["rule"], verdict=verdict))


def _judge(rules: list[Rule]) -> Callable:
    trie = RuleTrie(rules)

    @F.pandas_udf("host string, path string, best struct<labels:int,length:int,block:boolean,rule:string>")
    def judge(urls: pd.Series) -> pd.DataFrame:
        hosts, paths, found = [], [], []
        for text in urls:
            host, path = split_url(text)
            hit = trie.match(host, path)
            hosts.append(host)
            paths.append(path)
            found.append(None if hit is None else (*hit[0], hit[1].name))
        best = pd.DataFrame([x or (None, None, None, None) for x in found],
                            columns=["labels", "length", "block", "rule"], dtype=object)
        return pd.DataFrame({"host": hosts, "path": paths, "best": best.to_dict("records")})

    return judge
