"""Periods: folds over a grid, combs, spacings, autocorrelation, spectra, tracks and dips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_fold(df: DataFrame, time: str, periods: list[float], by: list[str] = ()) -> DataFrame:
    """Rayleigh Z2 per period: (2/n)((sum cos)^2 + (sum sin)^2).

    The grid is exploded inside each row, and sums combine before the shuffle:
    what is shuffled is one row per task and period, whatever the events.
    """
    by = list(by)
    rows = df.select(*by, F.col(time).alias("t"), F.explode(F.array(*[F.lit(float(p)) for p in periods])).alias("period"))
    phase = 2.0 * math.pi * F.pmod(F.col("t") / F.col("period"), F.lit(1.0))
    sums = rows.groupBy(*by, "period").agg(F.count("*").alias("n"), F.sum(F.cos(phase)).alias("c"), F.sum(F.sin(phase)).alias("s"))
    z2 = 2.0 / F.col("n") * (F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    angle = F.pmod(F.atan2("s", "c") / (2.0 * math.pi), F.lit(1.0))
    return sums.select(*by, "period", "n", z2.alias("z2"), angle.alias("phase"), F.exp(-z2 / 2.0).alias("p"))


def best_period(folded: DataFrame, by: list[str] = ()) -> DataFrame:
    """The period with the largest Z2; the shortest wins a tie."""
    best = F.max_by(F.struct("period", "z2", "phase", "p", "n"), F.struct("z2", -F.col("period")))
    return folded.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def period_grid(center: float, margin: float, steps: int, floor: float | None = None) -> list[float]:
    low = center - margin if floor is None else max(floor, center - margin)
    return [low + (center + margin - low) * k / (steps - 1) for k in range(steps)]


def comb_hits(df: DataFrame, value: str, spacing: float, tolerance: float) -> Column:
    """Whether a value lies within ``tolerance`` of a multiple of ``spacing``."""
    off = F.pmod(F.col(value), F.lit(spacing))
    return F.least(off, spacing - off) <= tolerance


def spacing_regularity(df: DataFrame, value: str, by: list[str] = (), most: float = 0.05) -> DataFrame:
    """Spacings of sorted values: mean, sd, coefficient of variation, and whether that is at most ``most``."""
    w = Window.partitionBy(*by).orderBy(value)
    gaps = df.select(*by, (F.col(value) - F.lag(value).over(w)).alias("gap")).filter("gap is not null")
    out = gaps.groupBy(*by).agg(F.count("*").alias("n_gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd_gap"))
    out = out.withColumn("cv", F.col("sd_gap") / F.nullif(F.col("mean_gap"), F.lit(0.0)))
    return out.withColumn("regular", F.coalesce(F.col("cv") <= most, F.lit(False)))


def autocorrelation(df: DataFrame, by: list[str], order: str, value: str, lags: int) -> DataFrame:
    """r[k] / r[0] for lags 0..``lags`` (biased, mean taken out)."""
    w = Window.partitionBy(*by)
    centred = df.select(*by, order, (F.col(value) - F.avg(value).over(w)).alias("v"))
    shifted = [F.lag("v", k).over(w.orderBy(order)).alias(f"l{k}") for k in range(lags + 1)]
    sums = centred.select(*by, "v", *shifted).groupBy(*by).agg(*[F.sum(F.col("v") * F.col(f"l{k}")).alias(f"r{k}") for k in range(lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"r{k}") / F.nullif(F.col("r0"), F.lit(0.0))).alias("r")) for k in range(lags + 1)])
    return sums.select(*by, F.inline(pairs))


def power_spectrum(df: DataFrame, by: list[str], order: str, value: str, n_freqs: int) -> DataFrame:
    """Power at the first ``n_freqs`` Fourier frequencies (mean out, Hann window) as plain sums over a frequency grid."""
    w = Window.partitionBy(*by)
    rows = df.select(*by, (F.row_number().over(w.orderBy(order)) - 1).alias("i"), F.count("*").over(w).alias("n"), (F.col(value) - F.avg(value).over(w)).alias("v"))
    hann = 0.5 - 0.5 * F.cos(2.0 * math.pi * F.col("i") / F.nullif(F.col("n") - 1, F.lit(0)))
    rows = rows.select(*by, "i", "n", (F.col("v") * hann).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(n_freqs))).alias("k"))
    angle = 2.0 * math.pi * F.pmod(F.col("k") * F.col("i") / F.col("n"), F.lit(1.0))
    sums = rows.groupBy(*by, "k").agg(F.sum(F.col("v") * F.cos(angle)).alias("c"), F.sum(F.col("v") * F.sin(angle)).alias("s"))
    return sums.select(*by, "k", (F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("power"))


def track_kinematics(df: DataFrame, by: list[str], t: str, x: str, y: str) -> DataFrame:
    """Largest speed and acceleration of ordered points by finite differences; steps without time are skipped."""
    w = Window.partitionBy(*by).orderBy(t)
    step = df.select(*by, t, *[(F.col(c) - F.lag(c).over(w)).alias(f"d{k}") for k, c in (("t", t), ("x", x), ("y", y))]).filter("dt > 0")
    speed = step.withColumn("vx", F.col("dx") / F.col("dt")).withColumn("vy", F.col("dy") / F.col("dt"))
    dv = [((F.col(f"v{c}") - F.lag(f"v{c}").over(w)) / F.col("dt")).alias(f"a{c}") for c in "xy"]
    both = speed.select(*by, F.hypot("vx", "vy").alias("speed"), *dv)
    out = both.groupBy(*by).agg(F.count("*").alias("n_steps"), F.max("speed").alias("max_speed"), F.max(F.hypot("ax", "ay")).alias("max_accel"))
    return out.withColumn("max_g", F.col("max_accel") / 9.80665)


def sigma_dips(df: DataFrame, by: list[str], order: str, flux: str, sigmas: float = 3.0) -> DataFrame:
    """Samples that differ from their group's median flux by over ``sigmas`` standard deviations of the normalised flux.

    Medians and deviations are aggregates joined back, not windows over whole groups.
    """
    medians = df.groupBy(*by).agg(F.percentile(flux, F.lit(0.5)).alias("median"), F.stddev_pop(flux).alias("sd"))
    rows = df.join(medians, by).withColumn("norm", F.col(flux) / F.nullif(F.col("median"), F.lit(0.0)))
    return rows.filter(F.abs(F.col("norm") - 1.0) > sigmas * F.col("sd") / F.abs(F.col("median"))).select(*by, order, "norm")
