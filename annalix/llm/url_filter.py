"""URL rules indexed by their rarest literal token.

A rule is a host and path, or a regular expression over ``host + path`` for which the words that every
match contains as whole tokens are known. Tokens are maximal runs of ``[a-z0-9]`` in the lower-cased
host and the path. Each rule is filed under that of its tokens which fewest urls have. A url's
tokens fetch the rules filed under them, and only those run; rules without a token run on every url.

Host and path rules decide first, the longest wins (of equal ones the block rule). Where none fits, a
url is blocked if a pattern fits, else allowed. Token counts cover all urls, but only tokens of rules
are counted. The rules are part of the program; beyond ``rule_bytes`` of them a call is refused.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no host rule and is
judged by the patterns on the empty string (allowed by the rules here). Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import arrow_batches, share, tidy

TOKEN = re.compile(r"[a-z0-9]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return r"(?s)\A(?:[^/]*\.)?" + re.escape(self.host) + "\0" + re.escape(self.path)

    def tokens(self) -> list[str]:
        """Whole tokens of any url that fits: those of the host, and of the path up to its last separator."""
        path = self.path.translate(_ASCII_LOWER)
        return TOKEN.findall(self.host) + TOKEN.findall(path[: len(path) - len(re.search(r"[a-z0-9]*\Z", path)[0])])


@dataclass(frozen=True)
class Pattern:
    """Blocks urls in whose host or path the expression is found; ``tokens`` are whole tokens of every such url."""

    part: str  # host or path
    regex: str
    tokens: tuple[str, ...] = ()


def split_url(url: str | None) -> tuple[str, str]:
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_ASCII_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_tokens(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(host)) | set(TOKEN.findall(path.translate(_ASCII_LOWER)))


class Index:
    def __init__(self, rules: Sequence[HostRule | Pattern], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for r in rules:
            tokens = r.tokens() if isinstance(r, HostRule) else r.tokens
            item = (r, "both" if isinstance(r, HostRule) else r.part, re.compile(r.regex() if isinstance(r, HostRule) else r.regex))
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(item)
            else:
                self.always.append(item)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        texts = {"host": host, "path": path, "both": f"{host}\0{path}"}
        found = list(self.always)
        for t in url_tokens(host, path) & self.by_token.keys():
            found += self.by_token[t]
        fits = [r for r, part, x in found if x.search(texts[part])]
        own = [r for r in fits if isinstance(r, HostRule)]
        if own:
            best = min(own, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
            return best.name, best.verdict
        return None, "block" if fits else "allow"


def rule_token_counts(urls: DataFrame, rules: Sequence[HostRule | Pattern]) -> dict[str, int]:
    """In how many urls each token of a rule is; one row a rule token comes to the driver."""
    wanted = sorted({t for r in rules for t in (r.tokens() if isinstance(r, HostRule) else r.tokens)})
    if not wanted:
        return {}
    rest = F.regexp_extract("url", r"(?s)://(.*)", 1)
    tokens = F.array_distinct(F.split(F.lower(F.regexp_extract(rest, r"(?s)^[^?#]*", 0)), "[^a-z0-9]+"))
    hit = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    return {r[0]: r[1] for r in urls.select(F.explode(hit).alias("t")).groupBy("t").count().collect()}


def judge_urls(pages: DataFrame, rules: Sequence[HostRule | Pattern], rule_bytes: int = 16 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages."""
    if sum(len(r.regex() if isinstance(r, HostRule) else r.regex) for r in rules) > rule_bytes:
        raise ValueError("rules exceed rule_bytes")
    arrow_batches(pages.sparkSession)
    shared = share(pages.sparkSession, (tuple(rules), rule_token_counts(pages.select("url"), rules)))
    kind = pages.schema["page_id"].dataType.simpleString()
    text = lambda x: pa.array(x, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for b in batches:
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            got = [index.judge(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), text([h for h, _ in parts]), text([p for _, p in parts]), text([r for r, _ in got]), text([v for _, v in got])],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select("page_id", "url").mapInArrow(tidy(run), f"page_id {kind}, host string, path string, rule string, verdict string")


#: The host and path rules of the task.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: Hosts and paths of link farms, adult and gambling sites, and of pages without prose.
PATTERNS = (
    Pattern("host", r"(^|[^a-z0-9])spam-farm($|[^a-z0-9])", ("spam", "farm")),
    Pattern("host", r"(^|[^a-z0-9])link-farm($|[^a-z0-9])", ("link", "farm")),
    Pattern("host", r"(^|[^a-z0-9])linkfarm($|[^a-z0-9])", ("linkfarm",)),
    *(Pattern("host", rf"(^|[^a-z0-9]){w}($|[^a-z0-9])", (w,)) for w in ("casino", "porn", "xxx", "viagra", "warez", "escort")),
    *(Pattern("path", rf"(^|[^a-zA-Z0-9]){w}($|[^a-zA-Z0-9])", (w,)) for w in ("login", "logout", "signup", "cart", "checkout")),
)
