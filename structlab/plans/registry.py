"""Registration of named queries and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structlab.shared import checkpoints, shared_dir  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the DuckDB text of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places) + F.lit(0.0)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def seconds(ts: str) -> Column:
    return micros(ts) / F.lit(1e6)


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0))


#: DuckDB form of ``structlab.functions.rng.uniform``.
def sql_uniform(*parts: str, lane: int = 0) -> str:
    joined = " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({joined}), {1 + 8 * lane}, 8))::BIGINT / 4294967296.0::DOUBLE)"
