"""Mixing sources to target weights by repetition rates.

Tokens are summed per source, targets follow from the weights by water
filling, and each document is emitted floor(rate) times plus one hash-seeded
Bernoulli copy with the fraction as its probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structlab.llm.common import Scratch, bounded, word_count

#: Weights in the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix takes, and the most of its own size that a source gives.
SHARE, CAP = 1.5, 2
#: Independent Bernoulli draws per document; each source uses the one whose sum is nearest to its expectation.
DRAWS = 16
#: Most sources whose rates are broadcast.
SOURCE_BOUND = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """From (source, source_size): target and rate per source.

    Sources by code point, null last, take the weights in turn.  A source's
    target is min(cap * size, level * weight) with one level for all, which is
    what capping and sharing the excess by weight again and again comes to:
    with the sources sorted by cap * size / weight, those up to some place are
    capped and the rest share what is left.  The windows run over one row per
    source, never over documents.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    placed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = (
        placed.withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("goal", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    level = (F.col("goal") - F.col("cap_before")) / F.col("weight_left")
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    free = F.col("level") * F.col("weight") < F.col("cap")
    first_free = F.min(F.when(free, F.struct("place", "level"))).over(every)
    ranked = ranked.withColumn("final", first_free["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    ranked = ranked.withColumn("target", target)
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    return ranked.select("source", "source_size", "target", F.least(rate, F.lit(float(cap))).alias("rate"))


def draws(row_id: Column, seed: str = "mix", n: int = DRAWS) -> list[Column]:
    """Uniform numbers in [0, 1) that depend on seed and id alone; four from each MD5."""
    out = []
    for k in range(0, n, 4):
        digest = F.md5(F.concat_ws("|", F.lit(f"{seed}{k}"), F.coalesce(row_id.cast("string"), F.lit("null"))))
        out += [F.conv(F.substring(digest, 1 + 8 * j, 8), 16, 10).cast("double") / F.lit(4294967296.0) for j in range(4)]
    return out[:n]


def mix_plan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix",
    weights=WEIGHTS, share: float = SHARE, cap: int = CAP, source_bound: int = SOURCE_BOUND,
) -> DataFrame:
    """One row per source: source, source_size, target, rate, draw (which of the Bernoulli draws it uses).

    A document's size is its number of words (null text: 0).  Each source's sum
    of Bernoulli copies is steered by choosing, per source, among ``DRAWS``
    seeds the one whose emitted words come nearest to the expectation; every
    draw on its own has the fraction as its probability.  Sums combine before
    the shuffle, and rates reach the documents by a broadcast of checked size,
    so a hot source is no bottleneck; beyond ``source_bound`` sources the join
    is shuffled and adaptive execution splits hot keys.
    """
    work = Scratch(df.sparkSession, "source-mix")
    rows = df.select(F.col(id_col).alias("row_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = work.save(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = work.save(source_targets(sizes, weights, share, cap), "targets")
    n_sources = rates.count()
    rated = rows.alias("r").join(bounded(rates, source_bound, n_sources).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    rated = rated.select("r.row_id", "r.source", "r.size", "t.source_size", "t.rate")
    fraction = F.col("rate") - F.floor("rate")
    took = [F.sum(F.when(u < fraction, F.col("size")).otherwise(0)).alias(f"d{k}") for k, u in enumerate(draws(F.col("row_id"), seed))]
    sums = rated.groupBy("source").agg(F.first(fraction * F.col("source_size")).alias("expected"), *took)
    off = F.array(*[F.abs(F.col(f"d{k}") - F.col("expected")) for k in range(DRAWS)])
    best = sums.select(F.col("source").alias("best_source"), F.array_position(off, F.array_min(off)).cast("int").alias("draw"))
    plan = rates.join(best, F.col("source").eqNullSafe(F.col("best_source"))).drop("best_source")
    plan = work.save(plan, "plan")
    work.drop("sizes", "targets")
    return plan


def copies_of(row_id: Column, rate: Column, draw: Column, seed: str = "mix") -> Column:
    """floor(rate) copies and one more if the row's draw is below the fraction."""
    u = F.element_at(F.array(*draws(row_id, seed)), draw)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix",
    weights=WEIGHTS, share: float = SHARE, cap: int = CAP, source_bound: int = SOURCE_BOUND,
) -> DataFrame:
    """row_id, size, source_size, target, rate and copies of each row.

    A document never has more than ``cap`` copies.  Rows that repeat an id
    share its draw.  Sources of size 0 have target 0.  An empty table gives an
    empty result.
    """
    plan = mix_plan(df, id_col, text_col, source_col, seed, weights, share, cap, source_bound)
    rows = df.select(F.col(id_col).alias("row_id"), F.col(source_col).alias("row_source"), word_count(F.col(text_col)).alias("size"))
    rated = rows.join(bounded(plan, source_bound), F.col("row_source").eqNullSafe(F.col("source")))
    return rated.select("row_id", "size", "source_size", "target", "rate", copies_of(F.col("row_id"), F.col("rate"), F.col("draw"), seed).alias("copies"))


def emit_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", source_bound: int = SOURCE_BOUND) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it; texts aren't shuffled while rates are broadcast."""
    plan = bounded(mix_plan(df, id_col, text_col, source_col, seed, source_bound=source_bound), source_bound)
    rows = df.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"))
    rated = rows.join(plan, F.col("__source").eqNullSafe(F.col("source")))
    copies = copies_of(F.col("__id"), F.col("rate"), F.col("draw"), seed)
    return rated.select("__row", F.explode(F.array_repeat(F.lit(1), copies))).select("__row.*")
