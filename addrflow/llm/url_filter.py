"""URL rules indexed by their rarest literal token (DataFrame functions only)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest fitting rule decides."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> tuple[tuple[str, ...], ...]:
        # A token counts only if a delimiter ends it in the rule; the text before is a host label, so delimited too.
        return (tuple(re.findall(r"[a-z0-9]+(?=[^a-z0-9])", self.name) or [self.host.split(".")[-1]]),)


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased url, with whole tokens for each of its alternatives: every match contains
    all tokens of one alternative."""

    regex: str
    tokens: tuple[tuple[str, ...], ...]
    verdict: str = "block"

    @property
    def name(self) -> str:
        return self.regex


#: The rules that the contract fixes.
HOST_RULES = (HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow"))


def _label(*words: str) -> PatternRule:
    """A host label made of these words joined by hyphens."""
    return PatternRule(r"://([^/?#]*\.)?" + "-".join(words) + r"\.[^/?#]*", (words,))


#: Verdicts for urls that no host rule fits: host labels of spam, betting, pill and tracking sites.
PATTERN_RULES = (
    _label("cheap", "pills"),
    _label("casino", "win"),
    _label("free", "bets"),
    _label("spam", "farm"),
    _label("ads", "track"),
    PatternRule(r"://([^/?#]*[.-])?(casino|poker|viagra)[.-]", (("casino",), ("poker",), ("viagra",))),
    PatternRule(r"://([^/?#]*[.-])?(porn|xxx)[.-]", (("porn",), ("xxx",))),
    PatternRule(r"[?&](aff|affiliate)_?id=[^&#]*", (("aff", "id"), ("affid",), ("affiliate", "id"), ("affiliateid",))),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) after the first ``://``; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), "[^a-z0-9]+"))


def rarest_tokens(pages: DataFrame, url_col: str, rules) -> dict:
    """For each alternative of each rule its literal token that the fewest urls of the corpus hold; ties go to the first
    in byte order.

    One pass over the urls; at most one count for each token of the rules reaches the driver."""
    wanted = sorted({t for r in rules for own in r.tokens for t in own})
    token = F.explode(F.array_intersect(url_tokens(F.col(url_col)), F.array(*map(F.lit, wanted)))).alias("token")
    seen = {r["token"]: r["n"] for r in pages.select(token).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r: {min(own, key=lambda t: (seen.get(t, 0), t)) for own in r.tokens} for r in rules}


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, default: str = "allow") -> DataFrame:
    """Judge every url by host rules, and where none fits by pattern rules.

    The rules are indexed by their rarest literal token in this corpus, one for each alternative.  A url's tokens fetch the few rules that could
    fit it; only those are tried.  The rule list is code (tens of rules), so the index is a constant of the plan; rows are
    judged where they are read, without a shuffle.

    Returns id, host, path, rule (null if no host rule fits), verdict.  A null url or one without ``://`` has empty host
    and path and gets the default verdict.  Repeated rows are judged alike; other columns are ignored.  Rules of equal
    length go by the greater name.
    """
    rules = [*host_rules, *pattern_rules]
    index: dict[str, list] = {}
    for rule, tokens in rarest_tokens(pages, url_col, rules).items():
        for token in sorted(tokens):
            index.setdefault(token, []).append(rule)

    def row(r) -> Column:
        pattern = isinstance(r, PatternRule)
        values = {"regex": r.regex if pattern else "", "host": "" if pattern else r.host, "path": "" if pattern else r.path, "name": r.name, "verdict": r.verdict}
        return F.struct(*(F.lit(v).alias(k) for k, v in values.items()))

    # keys of the index, and at the same place the rules of each
    table = F.create_map(*(x for t, own in index.items() for x in (F.lit(t), F.array(*map(row, own)))))
    host, path = url_host_path(F.col(url_col))
    df = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.translate(F.coalesce(F.col(url_col), F.lit("")), _UPPER, _LOWER).alias("_url"), F.array_intersect(url_tokens(F.col(url_col)), F.array(*map(F.lit, index))).alias("_tokens"))
    candidates = F.flatten(F.transform("_tokens", lambda t: F.element_at(table, t)))
    df = df.withColumn("_rules", F.when(F.size("_tokens") > 0, candidates))
    fits = F.filter("_rules", lambda r: (r["regex"] == "") & ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["name"]).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    tried = F.array_min(F.transform(F.filter("_rules", lambda r: (r["regex"] != "") & F.rlike(F.col("_url"), r["regex"])), lambda r: r["verdict"]))
    df = df.withColumn("_best", best).withColumn("_tried", F.when(F.col("_best").isNull(), tried))
    return df.select(id_col, "host", "path", F.col("_best.name").alias("rule"), F.coalesce(F.col("_best.verdict"), F.col("_tried"), F.lit(default)).alias("verdict"))


def oracle_sql(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> str:
    """The same verdicts in plain SQL that tries every rule on every url."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(host_rules, key=lambda r: (len(r.name), r.name), reverse=True)
    fit = lambda r: f"(host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)})"
    rule = " ".join(f"WHEN {fit(r)} THEN {quote(r.name)}" for r in ordered)
    verdict = " ".join(f"WHEN {fit(r)} THEN {quote(r.verdict)}" for r in ordered)
    tried = " ".join(f"WHEN regexp_matches(low, {quote(p.regex)}) THEN {quote(p.verdict)}" for p in sorted(pattern_rules, key=lambda p: p.verdict))
    return f"""
WITH cut AS (SELECT page_id, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') AS low,
                    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     part AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {tried} ELSE 'allow' END AS verdict FROM part"""
