"""Known-answer generators: data with a planted structure, every value a function of seed and place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structlab.functions.rng import choice, normal, uniform


def periodic_train(spark: SparkSession, period: float, dt: float, n: int, noise: float, seed: str) -> DataFrame:
    """(i, t, v): a sine and noise."""
    t = F.col("id") * dt
    return spark.range(n).select(F.col("id").alias("i"), t.alias("t"), (F.sin(2.0 * math.pi * t / period) + noise * normal(seed, F.col("id"))).alias("v"))


def arrivals(spark: SparkSession, period: float, n: int, jitter: float, window: float, seed: str, start: float = 0.0) -> DataFrame:
    """(k, t): every period with jitter, within the window."""
    t = start + F.col("id") * period + jitter * normal(seed, F.col("id"))
    return spark.range(n).select(F.col("id").alias("k"), t.alias("t")).filter((F.col("t") >= start) & (F.col("t") <= start + window))


def uniform_times(spark: SparkSession, n: int, low: float, high: float, seed: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("k"), (low + (high - low) * uniform(seed, F.col("id"))).alias("t"))


def comb_peaks(spark: SparkSession, center: float, clock: float, harmonics: int, snr: float, decay: float) -> DataFrame:
    """(k, freq, snr): peaks at multiples of a clock around a centre."""
    k = F.col("id") - harmonics
    return spark.range(2 * harmonics + 1).select(k.alias("k"), (center + k * clock).alias("freq"), (snr - decay * F.abs(k)).alias("snr"))


def beam_samples(spark: SparkSession, mu: float, sigma: float, amplitude: float, n: int = 6) -> DataFrame:
    z = (F.col("id") - mu) / sigma
    return spark.range(n).select(F.col("id").alias("i"), (amplitude * F.exp(-0.5 * z * z)).alias("v"))


def sign_corpus(spark: SparkSession, n: int, heads: list[str], middles: list[str], tails: list[str], seed: str) -> DataFrame:
    """(seq, ord, token): head, one to four middles, tail."""
    body = F.transform(F.sequence(F.lit(1), 1 + F.floor(4 * uniform(seed, F.lit("n"), F.col("id"))).cast("int")), lambda i: choice(middles, seed, F.lit("m"), F.col("id"), i))
    tokens = F.concat(F.array(choice(heads, seed, F.lit("h"), F.col("id"))), body, F.array(choice(tails, seed, F.lit("t"), F.col("id"))))
    return spark.range(n).select(F.col("id").alias("seq"), F.posexplode(tokens).alias("ord", "token"))


def sticky_chain(spark: SparkSession, n_seqs: int, length: int, states: list[str], stay: float, seed: str) -> DataFrame:
    """(seq, ord, token): a first-order chain that keeps its state with probability ``stay``; a fold per sequence."""

    def step(acc, i):
        last = F.element_at(acc, -1)
        fresh = choice(states, seed, F.lit("c"), F.col("id"), i)
        return F.concat(acc, F.array(F.when(uniform(seed, F.lit("s"), F.col("id"), i) < stay, last).otherwise(fresh)))

    first = F.array(choice(states, seed, F.lit("0"), F.col("id")))
    tokens = F.aggregate(F.sequence(F.lit(1), F.lit(length - 1)), first, step)
    return spark.range(n_seqs).select(F.col("id").alias("seq"), F.posexplode(tokens).alias("ord", "token"))


def noise_grid(spark: SparkSession, n_grids: int, size: int, density: float, seed: str) -> DataFrame:
    """(grid, r, c, v): independent cells."""
    cells = size * size
    at = spark.range(n_grids * cells).select((F.col("id") / cells).cast("long").alias("grid"), (F.col("id") % cells).alias("p"))
    return at.select("grid", (F.col("p") / size).cast("long").alias("r"), (F.col("p") % size).alias("c"), (uniform(seed, F.col("grid"), F.col("p")) < density).cast("int").alias("v"))


def line_grid(spark: SparkSession, n_grids: int, size: int, every: int, noise: float, seed: str) -> DataFrame:
    """``noise_grid`` with every ``every``-th row set."""
    return noise_grid(spark, n_grids, size, noise, seed).withColumn("v", F.when(F.col("r") % every == 0, 1).otherwise(F.col("v")))


def track(spark: SparkSession, kind: str, n: int = 60, dt: float = 0.1) -> DataFrame:
    """(track, t, x, y): ballistic, a steady turn, or a jump in position."""
    t = F.col("id") * dt
    x, y = {
        "ballistic": (30.0 * t, 40.0 * t - 4.903325 * t * t),
        "turn": (200.0 * F.sin(t), 200.0 * (1.0 - F.cos(t))),
        "jerk": (30.0 * t + F.when(F.col("id") >= n // 2, 5000.0).otherwise(0.0), 0.0 * t),
    }[kind]
    return spark.range(n).select(F.lit(kind).alias("track"), t.alias("t"), x.alias("x"), y.alias("y"))
