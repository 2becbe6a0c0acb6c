"""Pairs of values whose ratio lies near a scale note, under a sweep of tolerances and two nulls, without making pairs.

A ratio near a note is a difference of log positions within a band around the
note, repeated each octave.  With the positions sorted, a band's pairs are two
range counts, so all that is needed is, for each end of a band, how many pairs
lie at least that far apart.  Positions are cut into tiles of equal width; the
pairs of two tiles are known from their sizes alone unless the end falls
between them, and those tiles meet as sorted arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlab.functions.ratio import DIATONIC
from structlab.functions.rng import key, uniform
from structlab.operators import nulls
from structlab.operators.ranks import global_ranks
from structlab.shared import settled

#: The tolerances of the sweep, in cents.
TOLERANCES = (5.0, 8.0, 10.0, 15.0, 20.0, 30.0, 50.0)
#: Least spread of a healthy null, in square roots of its mean, where none is calibrated.
SPREAD_FLOOR = 2.0
#: Least and most distinct positions that a tile holds, in expectation, and the tiles that a group is cut into between these.
TILE_LEAST, TILE_MOST, TILES = 4096, 65536, 8


def bands(tolerance: float, span: float) -> list[tuple[float, float]]:
    """Disjoint intervals of log2 distances up to ``span`` that lie within ``tolerance`` cents of a note, in any octave."""
    notes = sorted({math.log2(v) for _, v in DIATONIC})
    ends = sorted((k + note - tolerance / 1200, k + note + tolerance / 1200) for k in range(math.ceil(span) + 1) for note in notes)
    out: list[tuple[float, float]] = []
    for low, high in ends:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        elif low <= span:
            out.append((low, high))
    return out


def distant_pairs(df: DataFrame, by: list[str], y: str, ends: list[tuple[float, bool]], tile_values: int | None = None, zones: list[tuple[int, int]] = (), judge: Callable | None = None, value: str | None = None) -> DataFrame:
    """(by, end, n_pairs): unordered pairs of rows of a group at least ``ends[end]`` apart (more than that where the flag is set).

    Equal positions combine before the shuffle, so a position with many rows is
    one number with a weight.  ``zones`` are pairs of ends so close together that
    few pairs lie between them: those are looked at one by one and counted under
    the number ``judge(a, b)`` of their ``value`` instead of an end's.

    Tiles grow with the largest group up to a bound, so that up to TILES * TILE_MOST
    positions each is sent to at most TILES others, however many positions there are.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    weighted = settled(df.groupBy(*by, F.col(y).alias("__y")).agg(F.count("*").alias("__w"), F.min(value or y).cast("double").alias("__x")))
    low, high = weighted.agg(F.min("__y"), F.max("__y")).first()
    most = weighted.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if not most:
        return df.sparkSession.createDataFrame([], ", ".join(filter(None, [kinds, "end int, n_pairs long"])))
    tiles = -(-most // (tile_values or min(max(TILE_LEAST, -(-most // TILES)), TILE_MOST)))
    width = (high - low) / tiles or 1.0
    place = F.least(F.floor((F.col("__y") - low) / width).cast("int"), F.lit(tiles - 1))
    tiled = weighted.groupBy(*by, place.alias("__tile")).agg(F.array_sort(F.collect_list(F.struct("__y", "__w", "__x"))).alias("__v"), F.sum("__w").alias("__n"))
    fields = ["__y", "__w", *(["__x"] if zones else [])]
    tiled = settled(tiled.select(*by, "__tile", *[F.col(f"__v.{c}").alias(c) for c in fields], "__n"))
    cut, strict = np.array([e for e, _ in ends]), np.array([s for _, s in ends])
    first = np.floor(cut / width).astype(int)

    # Pairs of tiles that an end falls between meet; their distance in tiles is one of a few numbers.
    near = sorted({int(d) for f in first for d in (f - 1, f, f + 1) if 0 <= d < tiles})
    lower = tiled.select(*by, F.col("__tile").alias("__at"), *[F.col(c).alias(f"{c}2") for c in fields])
    upper = tiled.select(*by, *fields, "__tile", F.explode(F.array(*[F.lit(d) for d in near])).alias("__d")) if near else None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (a, wa, *xa), (b, wb, *xb) = ([batch.column(f"{c}{k}")[r].values.to_numpy(zero_copy_only=False) for c in fields] for k in ("", "2"))
                close = np.abs(first - batch.column("__d")[r].as_py()) <= 1
                mine = np.flatnonzero(close)
                below, before = (np.concatenate(([0], np.cumsum(w))) for w in (wb, wa))
                count = np.empty(len(mine), np.int64)
                for k, e in enumerate(mine):
                    # Only what falls between the first and the last position below is looked up.
                    at = a - cut[e]
                    low, high = np.searchsorted(at, b[0], "left"), np.searchsorted(at, b[-1], "right")
                    inside = below[np.searchsorted(b, at[low:high], "left" if strict[e] else "right")]
                    count[k] = wa[low:high] @ inside + (before[-1] - before[high]) * below[-1]
                judged: dict[int, int] = {}
                for near_end, far_end in zones:
                    if not (close[near_end] or close[far_end]):
                        continue
                    low, high = (np.searchsorted(b, a - cut[e], "left" if strict[e] else "right") for e in (far_end, near_end))
                    for i in np.flatnonzero(high > low):
                        for j in range(low[i], high[i]):
                            label = judge(float(xa[0][i]), float(xb[0][j]))
                            judged[label] = judged.get(label, 0) + int(wa[i]) * int(wb[j])
                numbers, found = [*mine.tolist(), *judged], [*count.tolist(), *judged.values()]
                groups = [batch.column(c).take(pa.array([r] * len(numbers))) for c in by]
                yield pa.RecordBatch.from_arrays([*groups, pa.array(numbers, pa.int32()), pa.array(found, pa.int64())], names=[*by, "end", "n_pairs"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                size = np.zeros(tiles, np.int64)
                size[batch.column("__tiles")[r].values.to_numpy(zero_copy_only=False)] = batch.column("__sizes")[r].values.to_numpy(zero_copy_only=False)
                at = np.correlate(size, size, "full")[tiles - 1 :]  # pairs of rows by the distance of their tiles
                beyond = np.concatenate((np.cumsum(at[::-1])[::-1], [0, 0]))
                count = beyond[np.clip(first + 2, 0, tiles)]
                every = int(size.sum())
                count[cut <= 0] = every * (every - 1) // 2  # all pairs; none is made above for such an end
                groups = [batch.column(c).take(pa.array([r] * len(cut))) for c in by]
                yield pa.RecordBatch.from_arrays([*groups, pa.array(np.arange(len(cut)), pa.int32()), pa.array(count)], names=[*by, "end", "n_pairs"])

    schema = ", ".join(filter(None, [kinds, "end int, n_pairs long"]))
    sizes = tiled.groupBy(*by).agg(F.collect_list("__tile").alias("__tiles"), F.collect_list("__n").alias("__sizes"))  # one number per tile
    out = sizes.mapInArrow(apart, schema)
    if upper is not None:
        every = [int(k) for k in np.flatnonzero(cut <= 0)]
        both = upper.withColumn("__at", F.col("__tile") - F.col("__d")).filter("__at >= 0").join(lower, [*by, "__at"])
        met = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "__tile", "__d").mapInArrow(meet, schema)
        out = out.unionByName(met.filter(~F.col("end").isin(every)) if every else met)
    return out.groupBy(*by, "end").agg(F.sum("n_pairs").alias("n_pairs"))


def note_hits(df: DataFrame, by: list[str], y: str, tolerances=TOLERANCES, tile_values: int | None = None) -> DataFrame:
    """(by, tol, n_hits): pairs of rows of a group whose values 2^y have a ratio within each tolerance of a note."""
    low, high = df.agg(F.min(y), F.max(y)).first()
    span = (high - low) if low is not None else 0.0
    ends, signs = [], []
    for t in tolerances:
        for a, b in bands(t, span):
            ends += [(a, False), (b, True)]
            signs += [(len(ends) - 2, t, 1), (len(ends) - 1, t, -1)]
    counts = distant_pairs(df, by, y, ends, tile_values)
    sign = df.sparkSession.createDataFrame(signs, "end int, tol double, sign int")  # a few per octave and tolerance
    return counts.join(F.broadcast(sign), "end").groupBy(*by, "tol").agg(F.sum(F.col("n_pairs") * F.col("sign")).alias("n_hits"))


def is_hit(a: Column, b: Column, tolerance: Column) -> Column:
    """Whether the values 2^a and 2^b have a ratio within a tolerance of a note."""
    d = F.abs(a - b)
    part = d - F.floor(d)
    off = F.array(*[F.abs(part - math.log2(v)) * 1200.0 for _, v in DIATONIC])
    return F.array_min(off) <= tolerance


def known_hits(values: DataFrame, known: DataFrame, by: list[str], tolerances=TOLERANCES) -> DataFrame:
    """(by, tol, n_known): hits among the pairs (a, b) of ids in ``known``; ``values`` has by, id and y."""
    v = F.explode(F.array(*[F.lit(float(t)) for t in tolerances])).alias("tol")
    a = known.join(values.select(*by, F.col("id").alias("a"), F.col("y").alias("ya")), "a")
    both = a.join(values.select(*by, F.col("id").alias("b"), F.col("y").alias("yb")), [*by, "b"])
    rows = both.select(*by, "ya", "yb", v)
    return rows.groupBy(*by, "tol").agg(F.count_if(is_hit(F.col("ya"), F.col("yb"), F.col("tol"))).alias("n_known"))


def spread(values: Column, mean: Column) -> Column:
    """How far the largest of a null's counts lies above the mean, in square roots of it: about 0 where the null hardly varies."""
    return (values - mean) / F.sqrt(F.greatest(mean, F.lit(1.0)))


def tolerance_sweep(
    df: DataFrame, id_col: str, value: str, known: DataFrame, seed: str, n_trials: int = 50, tolerances=TOLERANCES, n_bootstraps: int = 20, multiplier: int = 4, tile_values: int | None = None
) -> DataFrame:
    """One row per tolerance: hits of all pairs and of those not in ``known`` (pairs a, b of ids), against two nulls.

    Null A draws each value log-uniformly within its decade.  Null B deals the
    values to other ids: that leaves the hits of all pairs as they are, so only
    the known pairs are evaluated again.  Its spread is held against a floor
    calibrated by resampling a pool of trials, trials and resamples being rows
    of one plan; ``degenerate`` says that it falls below, or that the 95th
    percentile of the null is the observed count.  Values that aren't positive
    take no part.
    """
    rows = df.filter(F.col(value) > 0).select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"))
    rows = rows.select("id", "v", F.log2("v").alias("y"))
    pool = max(n_bootstraps * multiplier, n_trials + 10)
    tol = [float(t) for t in tolerances]
    drawn = nulls.trials(rows, n_trials)
    drawn = drawn.select("trial", "id", ((F.floor(F.log10("v")) + uniform(f"{seed}-decade", F.col("trial"), F.col("id"))) * math.log2(10)).alias("y"))
    real = rows.select(F.lit(-1).alias("trial"), "id", "y")
    every = settled(real.unionByName(drawn))
    hits = note_hits(every, ["trial"], "y", tol, tile_values)
    of_known = known_hits(every, known, ["trial"], tol)
    counts = hits.join(of_known, ["trial", "tol"], "left").select("trial", "tol", F.col("n_hits").alias("n_all"), (F.col("n_hits") - F.coalesce("n_known", F.lit(0))).alias("n"))
    counts = settled(counts)
    observed = counts.filter("trial = -1").select("tol", F.col("n_all").alias("hits_all"), F.col("n").alias("hits_filt"))

    dealt = nulls.permute(nulls.trials(rows.select("id", "y"), pool), "y", ["id"], ["trial"], f"{seed}-deal")
    in_known = known_hits(dealt, known, ["trial"], tol)
    grid = df.sparkSession.range(pool).select(F.col("id").cast("int").alias("trial"), F.explode(F.array(*[F.lit(t) for t in tol])).alias("tol"))
    deals = grid.join(F.broadcast(observed), "tol").join(in_known, ["trial", "tol"], "left")  # one row per tolerance
    deals = settled(deals.select("trial", "tol", (F.col("hits_all") - F.coalesce("n_known", F.lit(0))).alias("n")))

    first = deals.filter(F.col("trial") < n_trials)
    decade = against(counts.filter("trial >= 0"), observed, "decade", n_trials)
    perm = against(first, observed, "perm", n_trials)
    resample = F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))).alias("boot")
    picks = df.sparkSession.range(pool).select(F.col("id").cast("int").alias("trial"), resample)
    picks = global_ranks(picks.withColumn("__key", key(f"{seed}-boot", F.col("boot"), F.col("trial"))), ["boot", "__key"], "__rank")
    picks = picks.filter(F.col("__rank") % pool < n_trials).select("trial", "boot")  # every resample has ``pool`` ranks
    boots = picks.join(deals, "trial").groupBy("tol", "boot").agg(F.max("n").alias("top"), F.avg("n").alias("mean"))
    floors = boots.groupBy("tol").agg(F.percentile(spread(F.col("top"), F.col("mean")), F.lit(0.05)).alias("floor_p05"))
    n, k = rows.count(), known.join(rows.select(F.col("id").alias("a")), "a", "left_semi").join(rows.select(F.col("id").alias("b")), "b", "left_semi").count()
    out = observed.join(decade, "tol").join(perm, "tol").join(floors, "tol")
    out = out.withColumn("n_pairs", F.lit(n * (n - 1) // 2)).withColumn("n_pairs_filt", F.lit(n * (n - 1) // 2 - k))
    out = out.withColumn("perm_spread", spread(F.col("perm_max"), F.col("perm_mean")))
    return out.withColumn("degenerate", (F.col("perm_spread") < F.col("floor_p05")) | (F.col("hits_filt") == F.col("perm_p95")))


def against(null: DataFrame, observed: DataFrame, name: str, n_trials: int) -> DataFrame:
    """(tol, mean, p50, p95, p99, max, share at or above the observed count) of a null's counts; names begin with ``name``."""
    both = null.join(F.broadcast(observed.select("tol", "hits_filt")), "tol")  # one row per tolerance
    aggs = [F.avg("n").alias(f"{name}_mean"), *[F.percentile("n", F.lit(p / 100)).alias(f"{name}_p{p}") for p in (50, 95, 99)]]
    above = F.count_if(F.col("n") >= F.col("hits_filt")) / F.lit(float(n_trials))
    return both.groupBy("tol").agg(*aggs, F.max("n").alias(f"{name}_max"), above.alias(f"p_{name}"))


def sweep_fixed_floor(row: Column) -> Column:
    """The rule without calibration: a spread below ``SPREAD_FLOOR``, or the 95th percentile on the observed count."""
    return (row["perm_spread"] < SPREAD_FLOOR) | (row["hits_filt"] == row["perm_p95"])


#: Half the width of the zones around the ends of a note's share, in octaves.
ZONE = 1e-9


def note_of(r: float, tolerance: float) -> tuple[int, bool]:
    """The place of the note nearest to a ratio reduced to an octave, to a millionth of a cent, the first winning a tie, and whether it is within the tolerance."""
    folded = r / 2.0 ** math.floor(math.log2(r))
    off = [abs(1200 * math.log2(folded / v)) for _, v in DIATONIC]
    return min((round(o, 6), k) for k, o in enumerate(off))[1], min(off) <= tolerance


def note_shares(df: DataFrame, by: list[str], y: str, tolerance: float, value: str | None = None) -> DataFrame:
    """(by, note, n_pairs, n_hits): pairs of rows by the note that their octave-reduced ratio is nearest to, and those within the tolerance of it.

    Range counts as in ``note_hits`` between the places where the note or its
    hits change; the pairs at such a place, whose ratio only arithmetic puts on
    one side or the other, are judged one by one from ``value``, the number whose
    log2 is ``y``.  Without it a ratio that is a power of two is a unison.
    """
    low, high = df.agg(F.min(y), F.max(y)).first()
    span = (high - low) if low is not None else 0.0
    notes = [math.log2(v) for _, v in DIATONIC]
    turns = {0.0, *((a + b) / 2 for a, b in zip(notes, notes[1:], strict=False)), *(n + s * tolerance / 1200 for n in notes for s in (-1, 1))}
    places = sorted(k + t for k in range(math.ceil(span) + 1) for t in turns if 0 <= t < 1)
    around: list[list[float]] = []
    for p in places[1:]:
        if around and p - ZONE <= around[-1][1]:
            around[-1][1] = p + ZONE
        else:
            around.append([p - ZONE, p + ZONE])

    def judge(a: float, b: float) -> int:
        if value is None:
            d = abs(a - b)
            ratio = 2.0 ** (round(d) if abs(d - round(d)) < ZONE else d)
        else:
            ratio = max(a, b) / min(a, b)
        place, hit = note_of(ratio, tolerance)
        return -1 - 2 * place - hit

    # Every distance lies between two zones or in one; those below the first zone include equal values.
    ends, parts = [(0.0, False)], []
    for zone in around:
        ends += [(zone[0], False), (zone[1], False)]
    for k in range(0, len(ends), 2):
        middle = ends[k][0] + (ends[k + 1][0] - ends[k][0]) / 2 if k + 1 < len(ends) else ends[k][0] + ZONE
        place, hit = note_of(2.0**middle, tolerance)
        for end, sign in ((k, 1), (k + 1, -1)):
            if end < len(ends):
                parts.append((end, DIATONIC[place][0], sign, int(hit)))
    parts += [(-1 - 2 * k - hit, DIATONIC[k][0], 1, hit) for k in range(len(DIATONIC)) for hit in (0, 1)]
    counts = distant_pairs(df, by, y, ends, zones=[(k, k + 1) for k in range(1, len(ends), 2)], judge=judge, value=value)
    of = F.broadcast(df.sparkSession.createDataFrame(parts, "end int, note string, sign int, hit int"))  # a few per octave
    n = F.col("sign") * F.col("n_pairs")
    return counts.join(of, "end").groupBy(*by, "note").agg(F.sum(n).alias("n_pairs"), F.sum(F.when(F.col("hit") == 1, n).otherwise(0)).alias("n_hits"))
