"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SAMPLE = "'S' || lpad({key}::varchar, 12, '0')"

# SQL twins of the stand-in profiles.
CTES = {
    "spend": f"""spend AS (
  SELECT 'spend' AS profile, {SAMPLE.format(key='o_custkey')} AS sample_id, p_brand AS feature,
         sum(round(l_extendedprice * (1 - l_discount) * 10000)::bigint)::double / 10000.0::double AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY o_custkey, p_brand)""",
    "mix": f"""mix AS (
  SELECT 'mix' AS profile, {SAMPLE.format(key='o_custkey')} AS sample_id, l_returnflag || l_linestatus AS feature,
         sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_returnflag, l_linestatus)""",
    "share": f"""share AS (
  SELECT 'share' AS profile, {SAMPLE.format(key='o_custkey')} AS sample_id, o_orderpriority AS feature,
         count(*)::double / (sum(count(*)) OVER (PARTITION BY o_custkey))::double AS value
  FROM orders GROUP BY o_custkey, o_orderpriority)""",
    "activity": f"""activity AS (
  SELECT 'activity' AS profile, {SAMPLE.format(key='user_id')} AS sample_id, event_type AS feature,
         sum(round(value * 100)::bigint)::double / (count(value)::double * 100.0::double) AS value
  FROM events GROUP BY user_id, event_type)""",
    "cells": """cells AS (
  SELECT * FROM spend UNION ALL SELECT * FROM mix UNION ALL SELECT * FROM share UNION ALL SELECT * FROM activity)""",
    "response": f"""response AS (
  SELECT {SAMPLE.format(key='c_custkey')} AS sample_id, c_acctbal AS balance,
         cents::double / (k::double * 100.0::double) AS avg_price, max_price, k::double AS n_orders
  FROM customer LEFT JOIN (
    SELECT o_custkey, sum(round(o_totalprice * 100)::bigint) AS cents, max(o_totalprice) AS max_price, count(*) AS k
    FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)""",
}
ALL = ("spend", "mix", "share", "activity", "cells")


def with_ctes(names, body: str) -> str:
    """Prefix the named stand-in definitions (and any CTEs that open ``body``)."""
    head = ",\n".join(CTES[n] for n in names)
    return f"WITH {head}\n{body}" if not body.lstrip().startswith(",") else f"WITH {head}{body.lstrip()}"


def query(name: str, sql: str | None = None, ctes=()):
    """Register a query; ``sql`` is the plain SQL with the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql) if ctes else sql
        return function

    return register


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding zero removes the sign of a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def r(expression: str, digits: int = 6) -> str:
    """SQL twin of ``rounded``."""
    return f"(round({expression}, {digits}) + 0.0::double)"


def md5_hash(seed, *keys: str) -> str:
    """SQL twin of ``seeded_hash``."""
    text = " || '|' || ".join([f"'{seed}'", *[f"{k}::varchar" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 15))::bigint)"
