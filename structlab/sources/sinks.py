"""Writers of feature tables, reports and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_feature_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def report(df: DataFrame, probe: str) -> DataFrame:
    """A one-row result as (probe, metric, value) rows and one JSON document per row."""
    numbers = [c for c, t in df.dtypes if t in ("bigint", "int", "double", "boolean", "float")]
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in numbers]), F.array(*[F.col(c).cast("double") for c in numbers]))
    return df.select(F.lit(probe).alias("probe"), F.explode(pairs).alias("metric", "value"))


def as_document(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("report"))


def markdown(df: DataFrame, title: str, most: int = 50) -> str:
    """Notes on a small result (at most ``most`` rows, as a page holds no more)."""
    rows = df.limit(most).collect()
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in rows)
