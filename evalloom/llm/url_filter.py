"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix. Its pattern is compiled to a regular expression, and the rule is
filed under that one of its whole literal tokens which the fewest rules share. A URL's tokens fetch
candidate rules from this index, and only the candidates' expressions are run.

The rules travel with the task in blocks of at most ``block_rules``; a larger rule set takes further
blocks over the same rows, so a worker's index has a fixed bound. Rows are judged one by one: there is
no shuffle, whatever the hosts' frequencies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.session import ship_package

_TOKEN = re.compile(r"[A-Za-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Matches ``host + path`` of a URL: the host or a subdomain of it, then the path prefix."""
        return rf"(?s)\A(?:[^/?#]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    def tokens(self) -> list[str]:
        """Literal tokens that every matching URL holds whole.

        The host is bounded on both sides. A path's last token is not: the URL may go on in it.
        """
        host = _TOKEN.findall(self.host)
        path = [m.group() for m in _TOKEN.finditer(self.path) if m.end() < len(self.path)]
        return host + path


class RuleIndex:
    """Rules by their rarest token; rules without a whole token stand under the empty one."""

    def __init__(self, rules: Iterable[UrlRule]):
        rules = list(rules)
        shared = Counter(t for r in rules for t in set(r.tokens()))
        self.by_token: dict[str, list[tuple[int, re.Pattern, UrlRule]]] = {}
        for r in rules:
            token = min(r.tokens(), key=lambda t: (shared[t], -len(t), t), default="")
            self.by_token.setdefault(token, []).append((len(r.name), re.compile(r.pattern), r))
        for found in self.by_token.values():
            found.sort(key=lambda x: (-x[0], x[2].name, x[2].verdict))

    def best(self, host: str, path: str) -> UrlRule | None:
        """The longest fitting rule; among equally long ones the first by name, then by verdict."""
        if not host and not path:
            return None
        target, best = host + path, None
        for token in {"", *_TOKEN.findall(host), *_TOKEN.findall(path)}:
            for length, pattern, rule in self.by_token.get(token, ()):
                key = (-length, rule.name, rule.verdict)
                if best is not None and best[0] <= key:
                    break
                if pattern.match(target):
                    best = (key, rule)
                    break
        return best[1] if best else None


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def url_filter(
    pages: DataFrame,
    rules: Iterable[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    block_rules: int = 50_000,
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of every row.

    A URL that is null, empty or without ``://`` has an empty host and path, fits no rule and gets
    ``default``. Repeated rows are judged row by row; other columns are ignored.
    """
    ship_package(pages.sparkSession)
    host, path = url_parts(F.col(url_col))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    out = out.withColumn("best", F.lit(None).cast("struct<rule: string, verdict: string>"))
    ordered = sorted(set(rules), key=lambda r: (r.name, r.verdict))
    for at in range(0, len(ordered), block_rules):
        fits = _fits(ordered[at : at + block_rules])
        out = out.withColumn("found", fits("host", "path"))
        longer = F.col("best").isNull() | (
            F.col("found.rule").isNotNull() & (F.length("found.rule") > F.length("best.rule"))
        )
        out = out.withColumn("best", F.when(longer & F.col("found.rule").isNotNull(), F.col("found")).otherwise(F.col("best"))).drop("found")
    return out.select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def _fits(rules: list[UrlRule]):
    plain = [(r.verdict, r.host, r.path) for r in rules]

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def fits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = RuleIndex(UrlRule(*r) for r in plain)
        for host, path in batches:
            found = [index.best(h, p) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame(
                {"rule": [r and r.name for r in found], "verdict": [r and r.verdict for r in found]}, dtype=object
            )

    return fits
