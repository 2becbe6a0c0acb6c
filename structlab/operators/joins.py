"""Joins beyond equality: nearest, band, interval, pairs, as-of.  Each blocks on a key, so none is a cross join of two large sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structlab.operators.ranks import running_sums


def nearest_dimension(df: DataFrame, dim: DataFrame, distance: Column, id_cols: list[str], dim_cols: list[str], tie: str) -> DataFrame:
    """Nearest row of a small dimension table for each row; ``distance`` is written over both sides' columns.

    The dimension is a fixed table (constants, monuments), hence the broadcast.
    """
    joined = df.crossJoin(F.broadcast(dim)).withColumn("distance", distance)
    best = F.min_by(F.struct(*dim_cols, "distance"), F.struct("distance", tie))
    return joined.groupBy(*id_cols).agg(best.alias("best")).select(*id_cols, "best.*")


def band_semi_join(df: DataFrame, other: DataFrame, value: str, other_value: str, tolerance: float) -> DataFrame:
    """Rows within ``tolerance`` of some value of ``other``: equality on cells of that width, each value in three."""
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    near = other.select(F.col(other_value).alias("__v"), F.explode(F.array(*[cell(other_value) + k for k in (-1, 0, 1)])).alias("__cell"))
    left = df.withColumn("__cell", cell(value))
    return left.join(near, (left["__cell"] == near["__cell"]) & (F.abs(F.col(value) - F.col("__v")) <= tolerance), "left_semi").drop("__cell")


def interval_overlaps(left: DataFrame, right: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Pairs of half-open integer intervals (id, start, end) that overlap; ``width`` is the cell that blocks them.

    A pair is emitted in the cell in which its overlap begins, hence once.
    """
    cells = lambda s, e: F.sequence(F.floor(s / width).cast("long"), F.floor((e - 1) / width).cast("long"))
    a = left.select(F.col("id").alias("left_id"), F.col(start).alias("s"), F.col(end).alias("e")).withColumn("cell", F.explode(cells(F.col("s"), F.col("e"))))
    b = right.select(F.col("id").alias("right_id"), F.col(start).alias("s2"), F.col(end).alias("e2")).withColumn("cell", F.explode(cells(F.col("s2"), F.col("e2"))))
    both = a.join(b, "cell").filter((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")))
    both = both.filter(F.floor(F.greatest("s", "s2") / width).cast("long") == F.col("cell"))
    return both.select("left_id", "right_id", "s", "s2", (F.least("e", "e2") - F.greatest("s", "s2")).alias("overlap"))


def best_overlap(pairs: DataFrame) -> DataFrame:
    """Per left interval: the largest overlap, then the nearest start, then the smallest right id."""
    best = F.min_by(F.struct("right_id", "overlap"), F.struct(-F.col("overlap"), F.abs(F.col("s") - F.col("s2")), F.col("right_id")))
    return pairs.groupBy("left_id").agg(best.alias("best"), (F.count("*") > 1).alias("straddles")).select("left_id", "best.*", "straddles")


def best_overlap_whole(left: DataFrame, right: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """``best_overlap`` of all ``interval_overlaps``, without a row per pair: equal intervals share their answer.

    Each side is reduced to its distinct intervals first (the right one with its
    smallest id and its count), so pairs grow with distinct intervals, not with rows.
    """
    spots = left.select(start, end).distinct().withColumn("id", F.struct(F.col(start).alias("s"), F.col(end).alias("e")))
    spans = right.groupBy(start, end).agg(F.struct(F.min("id").alias("id"), F.count("*").alias("n")).alias("id"))
    pairs = interval_overlaps(spots, spans, start, end, width)
    best = F.min_by(F.struct("right_id.id", "overlap"), F.struct(-F.col("overlap"), F.abs(F.col("s") - F.col("s2")), F.col("right_id.id")))
    found = pairs.groupBy("left_id").agg(best.alias("best"), (F.sum("right_id.n") > 1).alias("straddles"))
    found = found.select(F.col("left_id.s").alias(start), F.col("left_id.e").alias(end), F.col("best.id").alias("right_id"), "best.overlap", "straddles")
    return left.join(found, [start, end]).select(F.col("id").alias("left_id"), "right_id", "overlap", "straddles")


def containment_join(long: DataFrame, short: DataFrame, text: str, part: str) -> DataFrame:
    """Rows of ``long`` with each row of ``short`` whose non-empty ``part`` occurs in ``text``.

    The lengths of parts are few; each text is cut into its distinct substrings
    of these lengths, which meet the parts by equality.  No pair is compared
    that doesn't match.
    """
    lengths = [r[0] for r in short.select(F.length(part).alias("n")).filter("n > 0").distinct().orderBy("n").collect()]  # numbers of characters
    if not lengths:
        return long.join(short, F.lit(False))
    whole = F.col(text)
    cut = lambda n: F.when(F.length(whole) >= n, F.transform(F.sequence(F.lit(1), F.length(whole) - (n - 1)), lambda i: F.substring(whole, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = F.array_distinct(F.flatten(F.array(*[cut(n) for n in lengths])))
    return long.select("*", F.explode(pieces).alias("__piece")).join(short, F.col("__piece") == F.col(part)).drop("__piece")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Latest right row at or before each left row: a union, then the last value seen per key; no range join."""
    l = left.withColumn("__side", F.lit(1))
    r = right.select(*by, time, *[F.col(v).alias(f"right_{v}") for v in values]).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True)
    filled = both.select(*[c for c in both.columns if not c.startswith("right_")], *[F.last(f"right_{v}", ignorenulls=True).over(w).alias(f"right_{v}") for v in values])
    return filled.filter("__side = 1").drop("__side")


def rechunk(df: DataFrame, lengths: DataFrame, by: list[str] = ()) -> DataFrame:
    """Deal flat streams (pos from 0, token) into words of given lengths (word, n), as (word, ord, token).

    Where each word begins follows from running sums over all words, less the
    sum at which its group begins; no task holds a group.
    """
    by = list(by)
    spans = running_sums(lengths, [*by, "word"], "n", "first")
    if by:
        starts = spans.groupBy(*by).agg(F.min("first").alias("__start"))
        spans = spans.join(starts, by).withColumn("first", F.col("first") - F.col("__start")).drop("__start")
    places = spans.filter("n > 0").select(*by, "word", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("ord")).withColumn("pos", F.col("first") + F.col("ord"))
    return df.join(places.drop("first"), [*by, "pos"]).select(*by, "word", "ord", "token")
