"""URL verdicts: host and path rules, then a weighted vocabulary counted with Aho-Corasick.

The longest rule that fits decides.  Otherwise the lower-cased URL is searched
for all terms in one pass; a hit counts if no ASCII letter or digit touches it.
One strict term or two different soft terms block.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

STRICT = ("adult", "casino", "escort", "porn", "poker", "sex", "viagra", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "click", "farm", "free", "jackpot", "loan", "pills", "promo", "spam", "track", "win")
#: (verdict, rule), a rule being a host with a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SOFT_LIMIT = 2


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule; null if none fits."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + prefix))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def _touches(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def hits(text: str, automaton) -> tuple[int, int]:
    """Strict hits and different soft terms of a lower-cased text."""
    strict, soft = 0, set()
    for end, (term, weight) in automaton.iter(text):
        if not _touches(text, end + 1) and not _touches(text, end - len(term)):
            if weight:
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def judge(pages: DataFrame, page: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT) -> DataFrame:
    """page, host, path, rule, verdict, n_strict, n_soft of every row.

    A null url, or one without ``://``, has empty host and path and no rule; its
    text, if any, is searched all the same.  Repeated rows each get a row; other
    columns are not read.
    """
    @F.pandas_udf("n_strict int, n_soft int")
    def count(urls: pd.Series) -> pd.DataFrame:
        automaton = _automaton(strict, soft)
        return pd.DataFrame([hits(u, automaton) if u else (0, 0) for u in urls], columns=["n_strict", "n_soft"])

    link = F.col("url_text")
    rows = pages.select(F.col(page).alias("page_key"), F.col(url).cast("string").alias("url_text"))
    rows = rows.withColumns({"host": host_of(link), "path": path_of(link)})
    rows = rows.withColumns({"match": rule_of(F.col("host"), F.col("path"), rules), "hits": count(F.lower(F.coalesce(link, F.lit(""))))})
    rejected = (F.col("hits.n_strict") > 0) | (F.col("hits.n_soft") >= SOFT_LIMIT)
    return rows.select(
        F.col("page_key").alias(page), "host", "path", F.col("match.rule").alias("rule"),
        F.coalesce("match.verdict", F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        "hits.n_strict", "hits.n_soft")
