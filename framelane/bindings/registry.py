"""Registry of queries and their oracle SQL, and the stand-in inputs both sides share.

The stand-ins are written once as SQL text that Spark and DuckDB read alike, so both sides start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its oracle (left out where SQL cannot express the operator)."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stand_in(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    """Project a given table with a column list shared with the oracle."""
    out = table(spark, sf_dir, name)
    return out.select(*[F.expr(c) for c in split_columns(columns)])


def split_columns(columns: str) -> list[str]:
    """Split a select list at top-level commas."""
    parts, depth, quoted, current = [], 0, False, ""
    for ch in columns:
        if ch == "'":
            quoted = not quoted
        if not quoted:
            depth += ch in "(["
            depth -= ch in ")]"
            if ch == "," and depth == 0:
                parts.append(current.strip())
                current = ""
                continue
        current += ch
    return [p for p in [*parts, current.strip()] if p]


def result(df: DataFrame, *columns: str) -> DataFrame:
    """Final projection ``name`` or ``name:type`` (types: i bigint, d double rounded to 6 or to the digits given, s string, b boolean)."""
    out = []
    for item in columns:
        name, _, kind = item.partition(":")
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind.startswith("d"):
            c = F.round(c.cast("double"), int(kind[1:] or 6))
        elif kind == "s":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)
