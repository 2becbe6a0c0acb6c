"""Least squares, grid searches and classifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def dipole_grid(df: DataFrame, ra: str, dec: str, value: str, error: str, n_ra: int, n_dec: int, by: list[str] = ()) -> DataFrame:
    """Weighted fit of value = amplitude cos(angle) + monopole for each direction of a grid.

    All directions share one pass: the grid is exploded in each row and six
    weighted sums combine before the shuffle.
    """
    by = list(by)
    cells = [(360.0 * (i + 0.5) / n_ra, -90.0 + 180.0 * (j + 0.5) / n_dec) for i in range(n_ra) for j in range(n_dec)]
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("ra0"), F.lit(d).alias("dec0")) for a, d in cells]))
    rows = df.select(*by, F.radians(ra).alias("a"), F.radians(dec).alias("d"), F.col(value).alias("v"), F.pow(F.col(error), F.lit(-2.0)).alias("w"), grid.alias("g"))
    cosine = F.sin("d") * F.sin(F.radians("g.dec0")) + F.cos("d") * F.cos(F.radians("g.dec0")) * F.cos(F.col("a") - F.radians("g.ra0"))
    rows = rows.select(*by, "g.*", "v", "w", cosine.alias("x"))
    s = {k: F.sum(e) for k, e in {"sw": F.col("w"), "sx": F.col("w") * F.col("x"), "sy": F.col("w") * F.col("v"), "sxx": F.col("w") * F.col("x") * F.col("x"), "sxy": F.col("w") * F.col("x") * F.col("v"), "syy": F.col("w") * F.col("v") * F.col("v")}.items()}
    sums = rows.groupBy(*by, "ra0", "dec0").agg(F.count("*").alias("n"), *[e.alias(k) for k, e in s.items()])
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    cov = F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = F.col("sw") * F.col("syy") - F.col("sy") * F.col("sy")
    amplitude = cov / F.nullif(det, F.lit(0.0))
    r = cov / F.sqrt(F.nullif(det * var, F.lit(0.0)))
    return sums.select(
        *by, "ra0", "dec0", "n", amplitude.alias("amplitude"), ((F.col("sy") - amplitude * F.col("sx")) / F.col("sw")).alias("monopole"),
        F.sqrt(F.col("sw") / F.nullif(det, F.lit(0.0))).alias("amplitude_error"), r.alias("r"), (F.abs(r) * F.sqrt(F.col("n").cast("double"))).alias("score"),
    )


def best_dipole(grid: DataFrame, by: list[str] = ()) -> DataFrame:
    best = F.max_by(F.struct("ra0", "dec0", "amplitude", "monopole", "r", "score", "n"), F.struct("score", -F.col("ra0"), -F.col("dec0")))
    return grid.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def beam_shape(shape: str, z: Column) -> Column:
    """A Gaussian, or a sinc, of places in widths from its middle."""
    return F.exp(-0.5 * z * z) if shape == "gaussian" else F.when(z == 0, 1.0).otherwise(F.sin(math.pi * z) / (math.pi * F.nullif(z, F.lit(0.0))))


def beam_grid(df: DataFrame, index: str, value: str, shape: str, mus: list[float], sigmas: list[float], by: list[str] = ()) -> DataFrame:
    """Least-squares fit of amplitude x shape((i - mu) / sigma) over a grid of mu and sigma; the amplitude is closed-form."""
    by = list(by)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("mu"), F.lit(s).alias("sigma")) for m in mus for s in sigmas]))
    rows = df.select(*by, F.col(index).cast("double").alias("i"), F.col(value).cast("double").alias("v"), cells.alias("g"))
    z = (F.col("i") - F.col("g.mu")) / F.col("g.sigma")
    rows = rows.select(*by, "g.*", "v", beam_shape(shape, z).alias("f"))
    sums = rows.groupBy(*by, "mu", "sigma").agg(
        F.sum(F.col("f") * F.col("v")).alias("fv"), F.sum(F.col("f") * F.col("f")).alias("ff"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.avg("v").alias("mean"), F.count("*").alias("n")
    )
    amp = F.col("fv") / F.nullif(F.col("ff"), F.lit(0.0))
    rss = F.col("vv") - amp * F.col("fv")
    tss = F.col("vv") - F.col("n") * F.col("mean") * F.col("mean")
    return sums.select(*by, "mu", "sigma", amp.alias("amplitude"), rss.alias("rss"), (1.0 - rss / F.nullif(tss, F.lit(0.0))).alias("r2"))


def best_beam(grid: DataFrame, by: list[str] = ()) -> DataFrame:
    best = F.min_by(F.struct("mu", "sigma", "amplitude", "rss", "r2"), F.struct("rss", "mu", "sigma"))
    return grid.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def train_classifiers(df: DataFrame, features: list[str], label: str, folds: int = 5) -> DataFrame:
    """Cross-validated accuracy of logistic regression and a random forest on standardised features.

    Folds are dealt by a hash of the row's features, so they don't depend on partitioning.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = df.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("label")).dropna()
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(*features), F.lit(folds)).cast("int")).checkpoint()
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    out = None
    for name, model in (("logistic", LogisticRegression(maxIter=50)), ("forest", RandomForestClassifier(numTrees=30, seed=7))):
        for k in range(folds):
            fitted = Pipeline(stages=[*stages, model]).fit(rows.filter(F.col("fold") != k))
            part = fitted.transform(rows.filter(F.col("fold") == k)).select(F.lit(name).alias("model"), F.lit(k).alias("fold"), (F.col("prediction") == F.col("label")).cast("double").alias("hit"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("model").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))
