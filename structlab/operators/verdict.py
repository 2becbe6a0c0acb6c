"""Calibration, effect sizes, verdict rules and the guard on claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The label of the first rule that holds (null counts as not)."""
    out = None
    for test, label in rules:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def all_of(*rules: tuple[Column, str], none: str) -> Column:
    """Labels of every rule that holds, joined by bars."""
    labels = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), label) for t, label in rules]), lambda x: x.isNotNull())
    return F.when(F.size(labels) == 0, none).otherwise(F.array_join(labels, " | "))


def structure_verdict(p: Column, z: Column, n: Column, least: int = 6, p_most: float = 0.01, z_least: float = 2.6) -> Column:
    return first_of((n < least, "UNDERDETERMINED"), ((p < p_most) & (F.abs(z) > z_least), "STRUCTURE"), otherwise="NO_STRUCTURE")


def null_gate_verdict(known_ok: Column, observed: Column, threshold: Column, prefix: str) -> Column:
    """A known answer must be found before a real result may count."""
    return first_of((~known_ok, "INSTRUMENT_FAILED"), (observed > threshold, f"{prefix}_STRUCTURE"), otherwise=f"NO_{prefix}_STRUCTURE")


def z_bands(z: Column, degenerate: Column, weak: float = 1.5, strong: float = 3.0) -> Column:
    return first_of((degenerate, "NULL_DEGENERATE"), (F.abs(z) >= strong, "STRONG"), (F.abs(z) >= weak, "WEAK"), otherwise="NONE")


def calibrate(df: DataFrame, kind: str, score: str, null_kinds: list[str], q: float = 0.99) -> DataFrame:
    """Threshold = quantile of the null scores; share at or above it per kind (false positives, or power)."""
    threshold = df.filter(F.col(kind).isin(null_kinds)).agg(F.percentile(score, F.lit(q)).alias("threshold"))
    out = df.crossJoin(F.broadcast(threshold)).groupBy(kind, "threshold")
    return out.agg(F.count("*").alias("n"), F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("rate"))


def group_effects(df: DataFrame, group: str, a, b, value: str, by: list[str] = ()) -> DataFrame:
    """Cohen's d and Welch's z of two groups in one pass."""
    pick = lambda g: F.when(F.col(group) == g, F.col(value))
    out = df.groupBy(*by).agg(
        *[f.alias(n) for g, k in ((a, "a"), (b, "b")) for f, n in ((F.count(pick(g)), f"n_{k}"), (F.avg(pick(g)), f"mean_{k}"), (F.var_samp(pick(g)), f"var_{k}"))]
    )
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0)))
    off = F.col("mean_a") - F.col("mean_b")
    welch = F.sqrt(F.col("var_a") / F.nullif(F.col("n_a"), F.lit(0)) + F.col("var_b") / F.nullif(F.col("n_b"), F.lit(0)))
    return out.withColumn("cohens_d", off / F.nullif(pooled, F.lit(0.0))).withColumn("welch_z", off / F.nullif(welch, F.lit(0.0)))


def gap_z(largest: Column, mean: Column) -> Column:
    return (largest - mean) / F.sqrt(F.greatest(mean, F.lit(1.0)))


def forbidden_hits(text: Column, phrases: list[str]) -> Column:
    """The phrases that occur in a text, case folded, in their order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.contains(p.lower()), p) for p in phrases]), lambda x: x.isNotNull())


def assert_clean(df: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """``df``, failing as soon as a row with a forbidden phrase is computed."""
    hits = forbidden_hits(F.col(text), phrases)
    message = F.concat(F.lit("forbidden phrase: "), F.element_at(hits, 1))
    return df.withColumn(text, F.when(F.size(hits) > 0, F.raise_error(message).cast("string")).otherwise(F.col(text)))
