"""URL filtering by pattern rules that are indexed by their rarest literal token.

Every rule has a regular expression and literal tokens which any URL it fits must
contain.  Tokens are counted over the URLs at hand; each rule is filed under its
rarest token.  A URL's own tokens then fetch its candidate rules,
and only those candidates run their expressions.  The longest rule that fits
wins; host rules rank before the method's own.

Tokens of a URL are the runs of `[a-z0-9]+` of its lower-cased host and path,
each once, and the empty token, under which rules without a literal are filed.
Rows are judged where they are, so a host or token that many URLs share is no
hot spot.

Special cases: a null URL, or one without ``://``, has an empty host and path
and fits no host rule; equal page ids are judged row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Rules are broadcast, a few hundred bytes each: at most some 50 MB.
MOST_RULES = 100_000
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``text`` names a host rule (host, then path) or is None for one of the method's own."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    text: str | None = None


def host_rule(verdict: str, text: str) -> Rule:
    """A rule that fits a host, all its subdomains, and paths that start with its own.

    Only whole tokens may index it: those of the host, and those of the path that a `/` or other separator closes.
    """
    host, slash, rest = text.partition("/")
    path = slash + rest
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(verdict, rf"^([^/]*\.)?{re.escape(host)} {re.escape(path)}", tuple(dict.fromkeys([*re.findall("[a-z0-9]+", host.lower()), *whole])), text)


#: Fixed by the contract.
HOST_RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
#: The method's own rules, for URLs that no host rule fits; all others are allowed.
OWN_RULES = (
    Rule("block", r"^[^ ]*\bcheap-pills\b", ("cheap", "pills")),
    Rule("block", r"^([^ ]*\.)?free-casino\b", ("free", "casino")),
    Rule("block", r"^([^ ]*\.)?(ads|adserver|tracker)\.", ()),
)


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end; A-Z in lower case; empty without `://`."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def url_tokens(host: str, path: str) -> set[str]:
    return {"", *_TOKEN.findall(f"{host} {path}".lower())}


class RuleIndex:
    """Rules filed under their rarest token; each is compiled once in a worker, when a URL first asks for it."""

    def __init__(self, rules: tuple[Rule, ...], seen: dict[str, int], default: str):
        self.default = default
        self.compiled: dict[str, re.Pattern] = {}
        self.by_token: dict[str, list[tuple]] = {}
        for k, rule in enumerate(rules):
            rarest = min(rule.tokens, key=lambda t: (seen.get(t, 0), t), default="")
            rank = (rule.text is not None, len(rule.text or rule.pattern), -k)
            self.by_token.setdefault(rarest, []).append((rank, rule))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compiled": {}}  # patterns do not travel

    def fits(self, rule: Rule, subject: str) -> bool:
        pattern = self.compiled.get(rule.pattern)
        if pattern is None:
            pattern = self.compiled[rule.pattern] = re.compile(rule.pattern)
        return pattern.search(subject) is not None

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The text of the rule that wins (None: one of the method's own, or none) and the verdict."""
        subject, best = f"{host} {path}", None
        for token in url_tokens(host, path) & self.by_token.keys():
            for rank, rule in self.by_token[token]:
                if (best is None or rank > best[0]) and (host or rule.text is None) and self.fits(rule, subject):
                    best = (rank, rule)
        return (best[1].text, best[1].verdict) if best else (None, self.default)


def token_counts(pages: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands; pre-aggregated, one number a token."""
    spark = pages.sparkSession
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit("([a-z0-9]+)"), 1))
    wanted = F.broadcast(spark.createDataFrame([(w,) for w in words], "token string"))
    rows = pages.select(F.explode(tokens).alias("token")).join(wanted, "token").groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + OWN_RULES, default: str = "allow", url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict (existing columns of these names are replaced).

    The only shuffle is that of the token counts.  The index travels to the
    workers whole, which its checked size allows.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: split them by host suffix and judge in turn")
    spark = pages.sparkSession
    prepare(spark)
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    words = sorted({t for r in rules for t in r.tokens})
    index = spark.sparkContext.broadcast(RuleIndex(rules, token_counts(parsed, words) if words else {}, default))

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        rows = [index.value.judge(h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(rows, columns=["rule", "verdict"])

    out = parsed.withColumn("_rw_judged", judged("host", "path"))
    return out.withColumns({"rule": F.col("_rw_judged.rule"), "verdict": F.col("_rw_judged.verdict")}).drop("_rw_judged")
