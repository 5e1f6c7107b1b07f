"""URL filter: site rules first, then a weighted vocabulary of URL terms."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adgauge.llm.common import ascii_lower

# The rules of the query, in the order given.
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
)
# The vocabulary. A strict term rejects alone, soft terms in twos.
STRICT = (
    "adult", "bdsm", "camgirl", "camgirls", "casino", "casinos", "cheap-pills", "cialis", "erotic", "erotik", "escort", "escorts", "hentai", "hookup",
    "keygen", "milf", "nudes", "onlyfans", "payday-loan", "payday-loans", "porn", "porno", "sexcam", "sexcams", "spam-farm", "sportwetten", "viagra",
    "warez", "xxx",
)
SOFT = (
    "ads", "apuestas", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "cracked", "dating", "farm", "free", "gambling", "gewinnspiel", "giveaway",
    "gratis", "jackpot", "kostenlos", "loan", "loans", "lottery", "lotto", "nsfw", "nude", "payday", "pills", "poker", "prize", "replica", "roulette", "sex",
    "singles", "slots", "spam", "torrent", "torrents", "track", "webcam", "wetten", "win", "winner",
)
THRESHOLD = 2
# What percent-encoding is undone for the terms, in this order.
ENCODED = {f"%{ord(c):02x}": c for c in "abcdefghijklmnopqrstuvwxyz-0123456789"} | {f"%{ord(c):02x}": c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def vocabulary(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, threshold: int = THRESHOLD) -> dict[str, int]:
    """Weights of the terms: a strict one weighs the whole threshold, a soft one 1."""
    return {t: 1 for t in soft} | {t: threshold for t in strict}


def plain(url: Column) -> Column:
    """A-Z lower-cased, and percent-encoded letters, digits and hyphens as they are, each code once."""
    low = ascii_lower(url)
    decoded = low
    for code, char in ENCODED.items():
        decoded = F.replace(decoded, F.lit(code), F.lit(char))
    return F.when(F.contains(low, F.lit("%")), decoded).otherwise(low)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or for null."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, _, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def term_hits(url: Column, weights: Mapping[str, int], threshold: int) -> Column:
    """Struct of strict hits, soft hits (distinct terms of each) and their summed weight.

    One pass of an Aho-Corasick automaton per URL; a match counts if the characters beside it are not
    a-z or 0-9. The automaton is built once per Python worker from the vocabulary, which is a parameter.
    """
    terms = dict(weights)

    @F.pandas_udf("strict_hits long, soft_hits long, weight long")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in terms:
            automaton.add_word(term, term)
        automaton.make_automaton()
        inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def found(text: str) -> set[str]:
            seen, end = set(), len(text)
            for last, term in automaton.iter(text):
                first = last - len(term) + 1
                if (first == 0 or text[first - 1] not in inside) and (last + 1 == end or text[last + 1] not in inside):
                    seen.add(term)
            return seen

        for batch in batches:
            rows = []
            for text in batch:
                seen = found(text) if text and terms else ()
                strict = sum(terms[t] >= threshold for t in seen)
                rows.append((strict, len(seen) - strict, sum(terms[t] for t in seen)))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "weight"])

    return hits(plain(url))


def judge_urls(
    pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES,
    weights: Mapping[str, int] | None = None, threshold: int = THRESHOLD,
) -> DataFrame:
    """Adds host, path, rule, strict_hits, soft_hits and verdict (allow or block) to each row.

    A fitting site rule decides; without one, a URL is blocked whose distinct terms weigh `threshold`
    or more: one strict term, or several soft ones. Terms are sought in the URL with percent-encoded letters, digits and
    hyphens decoded; host and path are as given. A null URL has empty host and path, no hits and is
    allowed. Rows repeat as they come, an empty table gives no rows. Columns of `pages` with one of the new names are replaced.
    """
    weights = vocabulary(threshold=threshold) if weights is None else weights
    host, path = host_and_path(pages[url])
    hits = pages.select(*[c for c in pages.columns if c not in ("strict_hits", "soft_hits")], host.alias("#host"), path.alias("#path"), term_hits(pages[url], weights, threshold).alias("#hits"))
    rule, says = site_rule(F.col("`#host`"), F.col("`#path`"), rules)
    own = F.when(F.col("`#hits`.weight") >= threshold, "block").otherwise("allow")
    return hits.select(
        *[f"`{c}`" for c in pages.columns if c not in ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")],
        F.col("`#host`").alias("host"), F.col("`#path`").alias("path"), rule.alias("rule"),
        F.coalesce(says, own).alias("verdict"),
        F.col("`#hits`.strict_hits").alias("strict_hits"), F.col("`#hits`.soft_hits").alias("soft_hits"),
    )


def _sql() -> str:
    """The same over `pages` in SQL."""
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    cases = []
    for text, says in ordered:
        site, _, rest = text.partition("/")
        fits = f"(host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '/{rest}')"
        cases.append((fits, text, says))
    rule = " ".join(f"WHEN {fits} THEN '{text}'" for fits, text, _ in cases)
    says = " ".join(f"WHEN {fits} THEN '{verdict}'" for fits, _, verdict in cases)

    def count(terms: Sequence[str]) -> str:
        return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT" for t in terms)

    low = f"translate(coalesce(url, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    for code, char in ENCODED.items():
        low = f"replace({low}, '{code}', '{char}')"
    return f"""
WITH cut AS (
  SELECT page_id, {low} AS low,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits
  FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {says} WHEN strict_hits >= 1 OR soft_hits >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits
FROM parts"""


SQL = _sql()
