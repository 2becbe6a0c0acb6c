"""Binary and grey grids as rows (grid, r, c, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbour_agreement(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of right and lower neighbours that agree: two ordered windows per grid, no self-join."""
    right = F.lead("v").over(Window.partitionBy(*by, "r").orderBy("c"))
    below = F.lead("v").over(Window.partitionBy(*by, "c").orderBy("r"))
    rows = df.select(*by, "v", right.alias("right"), below.alias("below"))
    same = lambda c: F.when(F.col(c).isNotNull(), (F.col(c) == F.col("v")).cast("long"))
    total = F.count("right") + F.count("below")
    hits = F.coalesce(F.sum(same("right")), F.lit(0)) + F.coalesce(F.sum(same("below")), F.lit(0))
    return rows.groupBy(*by).agg((hits / F.nullif(total, F.lit(0))).alias("agreement"))


def symmetry(df: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of each grid with its left-right, up-down and half-turn images."""
    size = df.groupBy(*by).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    rows = df.join(size, by)
    images = F.explode(
        F.array(
            F.struct(F.lit("horizontal").alias("kind"), F.col("r").alias("r2"), (F.col("w") - 1 - F.col("c")).alias("c2")),
            F.struct(F.lit("vertical").alias("kind"), (F.col("h") - 1 - F.col("r")).alias("r2"), F.col("c").alias("c2")),
            F.struct(F.lit("half_turn").alias("kind"), (F.col("h") - 1 - F.col("r")).alias("r2"), (F.col("w") - 1 - F.col("c")).alias("c2")),
        )
    )
    moved = rows.select(*by, "v", images.alias("i")).select(*by, "v", "i.*")
    other = df.select(*by, F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("v").alias("v2"))
    return moved.join(other, [*by, "r2", "c2"]).groupBy(*by, "kind").agg(F.avg((F.col("v") == F.col("v2")).cast("double")).alias("agreement"))


def box_counts(df: DataFrame, by: list[str], sizes: list[int]) -> DataFrame:
    """Occupied boxes per size."""
    rows = df.filter("v = 1").select(*by, "r", "c", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("s"))
    boxes = rows.select(*by, "s", F.floor(F.col("r") / F.col("s")).alias("br"), F.floor(F.col("c") / F.col("s")).alias("bc")).distinct()
    return boxes.groupBy(*by, "s").agg(F.count("*").alias("n_boxes"))


def fractal_dimension(counts: DataFrame, by: list[str]) -> DataFrame:
    """Slope of log count over log(1 / size), with its R2."""
    rows = counts.select(*by, F.log(1.0 / F.col("s")).alias("lx"), F.log(F.col("n_boxes").cast("double")).alias("ly"))
    return rows.groupBy(*by).agg(F.regr_slope("ly", "lx").alias("dimension"), F.regr_r2("ly", "lx").alias("r2"))


def best_fractal_window(counts: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """The run of at least ``least`` consecutive sizes whose log-log fit has the largest R2."""
    w = Window.partitionBy(*by).orderBy("s")
    rows = counts.select(*by, F.row_number().over(w).alias("k"), F.log(1.0 / F.col("s")).alias("lx"), F.log(F.col("n_boxes").cast("double")).alias("ly"))
    n = rows.groupBy(*by).agg(F.max("k").alias("n"))
    spans = n.select(*by, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "n").withColumn("j", F.explode(F.sequence(F.col("i"), F.col("n")))).filter(F.col("j") - F.col("i") >= least - 1)
    joined = spans.join(rows, by).filter("k between i and j").groupBy(*by, "i", "j").agg(F.regr_slope("ly", "lx").alias("dimension"), F.regr_r2("ly", "lx").alias("r2"))
    best = F.max_by(F.struct("dimension", "r2", "i", "j"), F.struct("r2", -F.col("i"), "j"))
    return joined.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def lacunarity(df: DataFrame, by: list[str], box: int) -> DataFrame:
    """var / mean^2 + 1 of the mass in gliding boxes."""
    across = F.sum("v").over(Window.partitionBy(*by, "r").orderBy("c").rowsBetween(0, box - 1))
    wide = F.count("*").over(Window.partitionBy(*by, "r").orderBy("c").rowsBetween(0, box - 1))
    rows = df.select(*by, "r", "c", across.alias("m"), wide.alias("n")).filter(F.col("n") == box)
    down = Window.partitionBy(*by, "c").orderBy("r").rowsBetween(0, box - 1)
    mass = rows.select(*by, F.sum("m").over(down).alias("mass"), F.count("*").over(down).alias("n")).filter(F.col("n") == box)
    return mass.groupBy(*by).agg((F.var_pop("mass") / F.nullif(F.pow(F.avg("mass"), F.lit(2.0)), F.lit(0.0)) + 1.0).alias("lacunarity"))


def reading_order(kind: str, h: Column, w: Column) -> list[Column]:
    """Sort keys over (r, c) that give a reading order: row, row_rev, col, col_rev, boustrophedon, spiral_cw, spiral_ccw."""
    r, c = F.col("r"), F.col("c")
    if kind in ("row", "row_rev"):
        return [r, c] if kind == "row" else [-r, -c]
    if kind in ("col", "col_rev"):
        return [c, r] if kind == "col" else [-c, -r]
    if kind == "boustrophedon":
        return [r, F.when(r % 2 == 0, c).otherwise(-c)]
    if kind == "spiral_ccw":
        r, c, h, w = c, r, w, h
    ring = F.least(r, c, h - 1 - r, w - 1 - c)
    side = F.when(r == ring, 0).when(c == w - 1 - ring, 1).when(r == h - 1 - ring, 2).otherwise(3)
    along = F.when(side == 0, c).when(side == 1, r).when(side == 2, -c).otherwise(-r)
    return [ring, side, along]


def flatten_grid(df: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, bits): the grid read in an order."""
    size = df.groupBy(*by).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    keyed = df.join(size, by).select(*by, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(reading_order(kind, F.col("h"), F.col("w")))], F.col("v").cast("string").alias("v")).alias("e"))
    return keyed.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["v"]), "").alias("bits"))


def otsu_threshold(df: DataFrame, by: list[str]) -> DataFrame:
    """Otsu's threshold from the grey histogram: cumulative sums over at most 256 rows per grid."""
    hist = df.groupBy(*by, "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(*by)
    v = F.col("v").cast("double")
    rows = hist.select(*by, "v", F.sum("n").over(w).alias("w0"), F.sum(v * F.col("n")).over(w).alias("s0"), F.sum("n").over(all_of).alias("n_all"), F.sum(v * F.col("n")).over(all_of).alias("s_all"))
    w1 = F.col("n_all") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s_all") - F.col("s0")) / F.nullif(w1, F.lit(0))
    rows = rows.withColumn("between", F.col("w0").cast("double") * w1 * gap * gap)
    return rows.groupBy(*by).agg(F.max_by("v", F.struct(F.coalesce("between", F.lit(-1.0)), -F.col("v"))).alias("threshold"))


def lsb_chi_square(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Chi-square of values 2k against 2k + 1: low when least significant bits are overwritten."""
    pair = df.select(*by, F.floor(F.col(value) / 2).alias("k"), (F.col(value) % 2).alias("bit"))
    counts = pair.groupBy(*by, "k").agg(F.sum((F.col("bit") == 0).cast("long")).alias("even"), F.count("*").alias("n"))
    term = F.pow(F.col("even") - F.col("n") / 2.0, F.lit(2.0)) / F.nullif(F.col("n") / 2.0, F.lit(0.0))
    return counts.groupBy(*by).agg(F.sum(term).alias("chi2"), F.count("*").alias("n_pairs"))


def sierpinski_carpet(spark, order: int) -> DataFrame:
    """(r, c, v): cell is empty where some base-3 digit of both is 1."""
    n = 3**order
    rows = spark.range(n * n).select((F.col("id") / n).cast("long").alias("r"), (F.col("id") % n).alias("c"))
    hole = F.lit(False)
    for k in range(order):
        hole = hole | ((F.floor(F.col("r") / 3**k) % 3 == 1) & (F.floor(F.col("c") / 3**k) % 3 == 1))
    return rows.select("r", "c", F.when(hole, 0).otherwise(1).alias("v"))


def fft_peakiness(df: DataFrame, by: list[str], high_pass: int = 0) -> DataFrame:
    """Largest over mean spectral magnitude of each grid, without the constant (or a central square)."""
    import numpy as np
    import pandas as pd

    def peak(rows: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((int(rows["r"].max()) + 1, int(rows["c"].max()) + 1))
        g[rows["r"], rows["c"]] = rows["v"]
        m = np.abs(np.fft.fftshift(np.fft.fft2(g - g.mean())))
        y, x = m.shape[0] // 2, m.shape[1] // 2
        m[max(0, y - high_pass) : y + high_pass + 1, max(0, x - high_pass) : x + high_pass + 1] = 0
        return pd.DataFrame([[*[rows[c].iloc[0] for c in by], float(m.max() / max(m.mean(), 1e-12))]], columns=[*by, "peakiness"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.groupBy(*by).applyInPandas(peak, f"{kinds}, peakiness double")


def radius_sequence(df: DataFrame, by: list[str], order: str, radius: str, most_cv: float = 0.05) -> DataFrame:
    """Ratios of successive radii: mean, sd, cv and whether they are those of a log spiral."""
    w = Window.partitionBy(*by).orderBy(order)
    ratio = df.select(*by, (F.col(radius) / F.nullif(F.lag(radius).over(w), F.lit(0.0))).alias("ratio")).filter("ratio is not null")
    out = ratio.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ratio").alias("mean_ratio"), F.stddev_pop("ratio").alias("sd_ratio"))
    out = out.withColumn("cv", F.col("sd_ratio") / F.nullif(F.col("mean_ratio"), F.lit(0.0)))
    return out.withColumn("log_spiral", F.coalesce(F.col("cv") <= most_cv, F.lit(False)))


def log_spiral_circles(spark, n: int, r0: float = 1.0, shrink: float = 0.8, a: float = 1.0, b: float = 0.2, dtheta: float = math.pi / 6) -> DataFrame:
    """Circles of geometrically shrinking radius along a log spiral."""
    k = F.col("id").cast("double")
    theta = k * dtheta
    rho = a * F.exp(b * theta)
    return spark.range(n).select(F.col("id").alias("k"), (rho * F.cos(theta)).alias("x"), (rho * F.sin(theta)).alias("y"), (r0 * F.pow(F.lit(shrink), k)).alias("radius"))
