"""URL filters: host/path rules first, then a weighted vocabulary of terms.

The vocabulary is a table of (term, weight): terms of weight 1 or more are strict, terms of less are soft. A term counts where it stands between boundaries (no
ASCII letter or digit beside it) in the lower-cased URL. A URL is blocked by one strict term, or by ``soft_hits`` distinct soft ones. Terms
are found in one pass of an Aho-Corasick automaton. ``read_vocabulary`` takes the terms from a table (up to ``VOCABULARY_BOUND``, else it raises); the
default list is below.

Edge cases: a null URL, or one without ``://``, has an empty host and path and is allowed
unless its own text has blocking terms (null: allow). Repeated rows are judged alike; URLs are searched whole, however long; an empty
table gives an empty result; only ``key`` of the other columns is returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default vocabulary (fixed values; pass your own to ``judge_urls``).
STRICT_TERMS = (
    "porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "milf", "camgirl", "camgirls", "sexcam", "sexcams", "escort", "escorts", "viagra", "cialis",
    "casino", "cheap-pills", "spam-farm", "phishing", "malware", "ransomware", "botnet", "keylogger", "warez", "keygen", "cracked-software",
    "fake-id", "payday-loan", "payday-loans", "buy-followers", "essay-mill", "link-farm", "doorway-page", "carding",
)
SOFT_TERMS = (
    "adult", "adults", "bet", "bets", "betting", "bonus", "bonuses", "cheap", "crack", "cracked", "dating", "deal", "deals", "discount", "download", "erotic",
    "escape-room", "fetish", "free", "gamble", "gambling", "jackpot", "loan", "loans", "lottery", "mature", "mp3", "nude", "nudes", "pharmacy", "pills",
    "poker", "proxy", "replica", "roulette", "serial", "sex", "sexy", "singles", "slots", "spam", "torrent", "torrents", "unblocked", "weightloss", "win", "winner",
)
#: Terms that fit into every task.
VOCABULARY_BOUND = 200_000
SOFT_HITS = 2


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the default list (fixed values).
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def read_vocabulary(table: DataFrame, term: str = "term", weight: str = "weight") -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a table, lower-cased; of a term's weights the largest counts; null and empty terms, and weights of 0 or less, are left out."""
    low = F.lower(F.trim(term))
    rows = table.groupBy(low.alias("term")).agg(F.max(weight).alias("weight")).filter("term <> '' and weight > 0")
    found = rows.orderBy("term").limit(VOCABULARY_BOUND + 1).collect()
    if len(found) > VOCABULARY_BOUND:
        raise ValueError(f"the vocabulary has over {VOCABULARY_BOUND} terms")
    return [r["term"] for r in found if r["weight"] >= 1], [r["term"] for r in found if r["weight"] < 1]


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null. ``rules`` is a short, fixed list."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def term_hits(strict: Sequence[str], soft: Sequence[str]):
    """A pandas UDF: struct (strict_hits, soft_hits) of distinct terms in a URL."""
    import ahocorasick

    terms = {t: True for t in soft} | {t: False for t in strict}

    def automaton():
        found = ahocorasick.Automaton()
        for term, is_soft in terms.items():
            found.add_word(term, (term, is_soft))
        found.make_automaton()
        return found

    lower = {c: c + 32 for c in range(65, 91)}

    def beside(text: str, at: int) -> bool:
        return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()

    @F.pandas_udf("strict_hits int, soft_hits int")
    def hits(urls: pd.Series) -> pd.DataFrame:
        search = automaton() if terms else None
        rows = []
        for url in urls:
            found: set[tuple[str, bool]] = set()
            if search is not None and isinstance(url, str):
                text = url.translate(lower)
                for end, (term, is_soft) in search.iter(text):
                    if not beside(text, end + 1) and not beside(text, end - len(term)):
                        found.add((term, is_soft))
            n_soft = sum(is_soft for _, is_soft in found)
            rows.append((len(found) - n_soft, n_soft))
        return pd.DataFrame(rows, columns=["strict_hits", "soft_hits"])

    return hits


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """(key, host, path, rule, verdict, strict_hits, soft_hits) of every URL."""
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("_url"))
    rows = rows.select(key, "_url", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    rows = rows.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("_hits", term_hits(strict, soft)(F.col("_url")))
    by_terms = F.when((F.col("_hits.strict_hits") >= 1) | (F.col("_hits.soft_hits") >= soft_hits), "block").otherwise("allow")
    return rows.select(
        key,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_terms).alias("verdict"),
        F.col("_hits.strict_hits").cast("int").alias("strict_hits"),
        F.col("_hits.soft_hits").cast("int").alias("soft_hits"),
    )


def judge_urls_sql(strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_hits: int = SOFT_HITS) -> str:
    """DuckDB SQL of ``judge_urls`` over ``pages`` with the default rules."""

    def has(term: str) -> str:
        return f"coalesce(regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])'), false)::INTEGER"

    return f"""
    WITH u AS (
      SELECT page_id,
        translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
        translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
      FROM pages),
    r AS (
      SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
        {" + ".join(has(t) for t in strict)} AS strict_hits,
        {" + ".join(has(t) for t in soft)} AS soft_hits
      FROM u)
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
           WHEN strict_hits >= 1 OR soft_hits >= {soft_hits} THEN 'block' ELSE 'allow' END AS verdict,
      strict_hits::INTEGER AS strict_hits, soft_hits::INTEGER AS soft_hits
    FROM r"""
