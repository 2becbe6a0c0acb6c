"""Bits read from a raster along a spiral or a lattice, under a sweep of parameters."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structlab.operators.raster import extents, summed_area, window_means

#: Fixed values of the sweep: inner radii as shares of the outer one, and whole turns.
INNER, TURNS = (0.08, 0.12, 0.18), tuple(range(8, 21))


def sweep_grid(spark: SparkSession, turns=TURNS, inner=INNER, theta_steps: int = 8) -> DataFrame:
    """(cfg, turns, inner, outward, ccw, theta): every way to read a spiral; its size is a parameter."""
    ways = itertools.product(turns, inner, (True, False), (True, False), range(theta_steps))
    rows = [(k, float(t), float(i), o, c, 2 * math.pi * s / theta_steps) for k, (t, i, o, c, s) in enumerate(ways)]
    return spark.createDataFrame(rows, "cfg int, turns double, inner double, outward boolean, ccw boolean, theta double")


def spiral_points(configs: DataFrame, cx: Column, cy: Column, radius: Column, n_bits: int) -> DataFrame:
    """``configs`` once per bit, with the cell (r, c) where that bit lies: radius and angle grow evenly."""
    rows = configs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bits - 1))).alias("bit"))
    t = F.col("bit") / float(max(n_bits - 1, 1))
    r_in = radius * F.col("inner")
    along = F.when(F.col("outward"), r_in * (1 - t) + radius * t).otherwise(radius * (1 - t) + r_in * t)
    angle = F.col("theta") + F.when(F.col("ccw"), 1.0).otherwise(-1.0) * (t * F.col("turns") * (2 * math.pi))
    return rows.withColumn("r", F.rint(cy + along * F.sin(angle)).cast("long")).withColumn("c", F.rint(cx + along * F.cos(angle)).cast("long"))


def lattice_points(spark: SparkSession, box: tuple[int, int, int, int], rows: int, cols: int) -> DataFrame:
    """(gr, gc, r, c): centres of the cells of a ``rows`` by ``cols`` lattice over (r0, c0, r1, c1)."""
    r0, c0, r1, c1 = box
    k = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("gr"), (F.col("id") % cols).alias("gc"))
    centre = lambda g, low, high, n: low + F.floor((F.col(g) + 0.5) * (high - low) / n)
    return k.select("gr", "gc", centre("gr", r0, r1, rows).alias("r"), centre("gc", c0, c1, cols).alias("c"))


def at_least_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``df`` with ``on``: 1 where the value reaches the median of its group, else 0."""
    middle = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("__middle"))
    joined = df.join(middle, by) if by else df.crossJoin(F.broadcast(middle))  # one row
    return joined.withColumn("on", (F.col(value) >= F.col("__middle")).cast("int")).drop("__middle")


def read_points(cells: DataFrame, points: DataFrame, by: list[str], tile: int = 128) -> DataFrame:
    """``points`` with ``sample``: the mean of the 3 by 3 cells about each, as a share of 255; 0 outside the raster."""
    means = window_means(points, summed_area(cells, by, tile), extents(cells, by), by, 1)
    return means.withColumn("sample", F.coalesce(F.col("mean") / 255.0, F.lit(0.0))).drop("mean")


def sample_lattice(cells: DataFrame, box: tuple[int, int, int, int], rows: int, cols: int, tile: int = 128) -> DataFrame:
    """(gr, gc, sample, on) of a lattice over a raster; ``on`` by the median of all samples."""
    points = lattice_points(cells.sparkSession, box, rows, cols)
    return at_least_median(read_points(cells, points, [], tile), [], "sample").select("gr", "gc", "sample", "on")


def spiral_sweep(cells: DataFrame, by: list[str], configs: DataFrame, known: DataFrame, n_bits: int, top: int = 25, tile: int = 128) -> DataFrame:
    """The ``top`` readings (by, cfg, invert, error, name): share of bits that differ from the known sequence (name, bit, on) they come nearest to.

    The disc lies about the middle of each raster and takes a third of its
    shorter side.  Samples are made once per configuration; both polarities
    follow from one count.  ``known`` holds ``n_bits`` bits per name at most.
    """
    size = extents(cells, by)
    base = F.broadcast(configs).crossJoin(size) if not by else size.crossJoin(F.broadcast(configs))  # configurations are a parameter
    points = spiral_points(base, F.floor(F.col("w") / 2), F.floor(F.col("h") / 2), F.floor(F.least("w", "h") / 3), n_bits).drop("h", "w")
    read = read_points(cells, points.select(*by, "cfg", "bit", "r", "c"), by, tile)
    bits = at_least_median(read, [*by, "cfg"], "sample").select(*by, "cfg", "bit", F.col("on").alias("read"))
    scored = bits.join(F.broadcast(known), "bit").groupBy(*by, "cfg", "name").agg(F.avg((F.col("read") != F.col("on")).cast("double")).alias("e"))
    both = scored.select(*by, "cfg", "name", F.explode(F.array(F.struct(F.lit(False).alias("invert"), F.col("e").alias("error")), F.struct(F.lit(True).alias("invert"), (1.0 - F.col("e")).alias("error")))).alias("x"))
    best = both.select(*by, "cfg", "name", "x.*").groupBy(*by, "cfg", "invert").agg(F.min(F.struct("error", "name")).alias("m"))
    best = best.select(*by, "cfg", "invert", F.round("m.error", 4).alias("error"), "m.name")
    return best.orderBy("error", *by, "cfg", "invert").limit(top)
