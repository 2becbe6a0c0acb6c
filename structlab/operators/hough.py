"""Straight lines and circles by votes in parameter space."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlab.operators.raster import TILE, extents, sobel

#: Scale of the integer sines and cosines, so that a vote falls into the same cell on every machine.
SCALE = 65536


def direction(k: int, n: int) -> tuple[int, int]:
    """Cosine and sine of the k-th of ``n`` angles in half a turn, as whole numbers."""
    return math.floor(math.cos(math.pi * k / n) * SCALE + 0.5), math.floor(math.sin(math.pi * k / n) * SCALE + 0.5)


def rho(c: Column, r: Column, cos: Column, sin: Column) -> Column:
    """Distance of a line through (r, c) from the origin, to the nearest whole number."""
    return F.shiftright(c.cast("long") * cos + r.cast("long") * sin + SCALE // 2, 16)


def line_votes(points: DataFrame, by: list[str], n_angles: int = 180) -> DataFrame:
    """(by, theta, rho, votes): how many points (r, c) lie on each line; ``theta`` counts angles in half a turn.

    Each point votes once per angle inside its task, and votes combine before
    the shuffle; an accumulator is as large as the raster's diagonal, not its points.
    """
    angles = F.explode(F.array(*[F.struct(F.lit(k).alias("theta"), *(F.lit(v).cast("long").alias(n) for n, v in zip(("cos", "sin"), direction(k, n_angles), strict=True))) for k in range(n_angles)]))
    cast = points.select(*by, "r", "c", angles.alias("a")).select(*by, "a.theta", rho(F.col("c"), F.col("r"), F.col("a.cos"), F.col("a.sin")).alias("rho"))
    return cast.groupBy(*by, "theta", "rho").agg(F.count("*").alias("votes"))


def local_peaks(votes: DataFrame, by: list[str], least: int, n_angles: int = 180, near_theta: int = 2, near_rho: int = 2) -> DataFrame:
    """Cells of at least ``least`` votes that no cell near them beats; of equals the one with the smaller (theta, rho) stays.

    The last angle's neighbour is the first one with the other sign of the distance.
    """
    strong = votes.filter(F.col("votes") >= least)
    moves = [(a, b) for a in range(-near_theta, near_theta + 1) for b in range(-near_rho, near_rho + 1) if a or b]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in moves]))
    reach = strong.select("*", step.alias("s"))
    t, p = F.col("theta") + F.col("s.a"), F.col("rho") + F.col("s.b")
    turned = (t < 0) | (t >= n_angles)
    rank = lambda: F.struct(F.col("votes").alias("v"), (-F.col("theta")).alias("t"), (-F.col("rho")).alias("p"))
    reach = reach.select(*by, rank().alias("rival"), F.pmod(t, F.lit(n_angles)).cast("int").alias("theta"), F.when(turned, -p).otherwise(p).alias("rho"))
    best = reach.groupBy(*by, "theta", "rho").agg(F.max("rival").alias("rival"))
    joined = strong.join(best, [*by, "theta", "rho"], "left")
    return joined.filter(F.col("rival").isNull() | (rank() > F.col("rival"))).drop("rival")


def ring(radius: int, n_angles: int) -> list[tuple[int, int]]:
    """Cells of a circle that are looked at."""
    turn = [2 * math.pi * k / n_angles for k in range(n_angles)]
    return sorted({(math.floor(radius * math.sin(t) + 0.5), math.floor(radius * math.cos(t) + 0.5)) for t in turn})


def circle_votes(points: DataFrame, by: list[str], radii: list[int], n_angles: int = 64) -> DataFrame:
    """(by, radius, r, c, votes, fit): how many points lie about each centre at each radius, and their share of the cells looked at."""
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("radius"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(len(ring(s, n_angles))).alias("n")) for s in radii for a, b in ring(s, n_angles)]))
    cast = points.select(*by, "r", "c", steps.alias("s")).select(*by, "s.radius", "s.n", (F.col("r") - F.col("s.a")).alias("r"), (F.col("c") - F.col("s.b")).alias("c"))
    return cast.groupBy(*by, "radius", "r", "c").agg(F.count("*").alias("votes"), (F.count("*") / F.first("n")).alias("fit"))


def circles(points: DataFrame, by: list[str], radii: list[int], share: float = 0.6, apart: int = 4, n_angles: int = 64) -> DataFrame:
    """(by, radius, r, c, votes) of circles of which at least ``share`` is there and that no better one within ``apart`` cells of the centre beats."""
    strong = circle_votes(points, by, radii, n_angles).filter(F.col("fit") >= share)
    strong = strong.withColumn("own", F.struct("fit", "radius", (-F.col("r")).alias("r"), (-F.col("c")).alias("c")))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-apart, apart + 1) for b in range(-apart, apart + 1)]))
    best = strong.groupBy(*by, "r", "c").agg(F.max("own").alias("own")).select(*by, "own", "r", "c", around.alias("d"))
    top = best.groupBy(*by, (F.col("r") + F.col("d.a")).alias("r"), (F.col("c") + F.col("d.b")).alias("c")).agg(F.max("own").alias("top"))
    return strong.join(top, [*by, "r", "c"]).filter(F.col("own") == F.col("top")).select(*by, "radius", "r", "c", "votes")


def strong_edges(df: DataFrame, by: list[str], quantile: float = 0.9, tile: int = TILE) -> DataFrame:
    """(by, r, c) of the cells whose gradient exceeds a quantile of the raster's gradients that aren't zero."""
    g = sobel(df, by, tile).select(*by, "r", "c", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag")).filter("mag > 0")
    top = g.groupBy(*by).agg(F.percentile("mag", F.lit(quantile)).alias("least"))
    joined = g.join(F.broadcast(top), by) if by else g.crossJoin(F.broadcast(top))  # a row per raster
    return joined.filter(F.col("mag") > F.col("least") + 1e-9).select(*by, "r", "c")


def line_score(df: DataFrame, by: list[str], n_angles: int = 180, tile: int = TILE) -> DataFrame:
    """(by, votes, score): the most points of strong gradient on one line, against the raster's diagonal; 0 where there are none."""
    peaks = line_votes(strong_edges(df, by, tile=tile), by, n_angles).groupBy(*by).agg(F.max("votes").alias("votes"))
    size = extents(df, by)
    joined = size.join(peaks, by, "left") if by else size.crossJoin(peaks)
    votes = F.coalesce("votes", F.lit(0))
    return joined.select(*by, votes.alias("votes"), (100.0 * votes / F.sqrt((F.col("h") * F.col("h") + F.col("w") * F.col("w")).cast("double"))).alias("score"))


def calibrated(scores: DataFrame, kind: str, planted: str, quantile: float = 0.99) -> DataFrame:
    """(threshold, power, false_rate) from scores whose ``kind`` is ``planted`` or any other: the threshold is a quantile of the others."""
    null = scores.filter(F.col(kind) != planted).agg(F.percentile("score", F.lit(quantile)).alias("threshold"))
    rows = scores.crossJoin(F.broadcast(null))  # one row
    above = (F.col("score") > F.col("threshold")).cast("double")
    return rows.groupBy("threshold").agg(F.avg(F.when(F.col(kind) == planted, above)).alias("power"), F.avg(F.when(F.col(kind) != planted, above)).alias("false_rate"))
