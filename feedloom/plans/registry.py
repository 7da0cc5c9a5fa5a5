"""All registered queries of the library's own operators, with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from feedloom.plans import claims, comparisons, feeds, flows, ledgers, matching, records, texts
from feedloom.plans.rounding import COLUMNS, PLACES

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def _rounded(query: Callable, columns: list[str]) -> Callable:
    return lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: F.round(c, PLACES) + 0.0 for c in columns})


for module in (texts, matching, ledgers, comparisons, claims, feeds, flows, records):
    QUERIES |= module.P.queries
    ORACLE_SQL |= module.P.sql
for name, columns in COLUMNS.items():
    QUERIES[name] = _rounded(QUERIES[name], columns)
    replaced = ", ".join(f'round("{c}"::DOUBLE, {PLACES}) + 0.0 AS "{c}"' for c in columns)
    ORACLE_SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({ORACLE_SQL[name].strip()})"
