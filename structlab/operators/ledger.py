"""Ledgers: what stands before a tablet's first numeral, how predictable numerals are, and four invariants of accounting tablets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structlab.operators import nulls, sequence
from structlab.operators.ranks import neighbour_counts
from structlab.shared import settled

# Bounds of the invariants.
HEADER_SHARE, PREDICTABLE, LOCKED = 0.8, 0.8, -3.0
INVARIANTS = ("header_without_numerals", "header_bounded", "numerals_predictable", "locked_against_shuffles")


def ledger_statistics(df: DataFrame, corpus: str, tablet: list[str], place: list[str], token: str, numeral: str, n_trials: int, seed: str) -> DataFrame:
    """One row per corpus of signs: sizes of headers and lines, entropies of numerals, and the z of the lines against shuffles.

    A tablet's header is what stands before its first numeral; a tablet without
    numerals is header as a whole.  Numerals follow each other in the order of
    tablets and places, whatever stands between them; lines are shuffled within
    their corpus.  Orders are global, so no corpus is in one task.
    """
    keys = [*tablet, *place]
    rows = df.select(F.col(corpus).alias("corpus"), *keys, F.col(token).alias("token"), F.col(numeral).alias("num"))
    first = F.min(F.when(F.col("num"), F.struct(*place))).over(Window.partitionBy("corpus", *tablet))  # a tablet's signs
    rows = rows.withColumn("first", first)
    rows = settled(rows.withColumn("header", F.coalesce(F.struct(*place) < F.col("first"), F.lit(True))).drop("first"))
    size = rows.groupBy("corpus").agg(
        F.count_if("header").alias("n_header"), F.count_if(F.col("header") & F.col("num")).alias("n_header_numerals"), F.count_if(~F.col("header")).alias("n_lines"), F.count_if(~F.col("header") & F.col("num")).alias("n_numerals")
    )
    numerals = rows.filter("num and not header")
    h1 = sequence.unigram_entropy(numerals, ["corpus"]).select("corpus", F.col("entropy").alias("h1"))
    h2 = sequence.conditional_entropy(neighbour_counts(numerals, ["corpus"], ["corpus", *keys], "token"), ["corpus"]).select("corpus", F.col("cond_entropy").alias("h2"))
    lines = rows.filter("not header").select("corpus", *keys, "token")
    observed = sequence.conditional_entropy(neighbour_counts(lines, ["corpus"], ["corpus", *keys], "token"), ["corpus"])
    shuffled = nulls.shuffled_neighbours(nulls.trials(lines, n_trials), "token", keys, ["corpus", "trial"], seed)
    z = nulls.summarize(observed, sequence.conditional_entropy(shuffled, ["corpus", "trial"]), "cond_entropy", ["corpus"]).select("corpus", "z")
    out = size.join(h1, "corpus", "left").join(h2, "corpus", "left").join(z, "corpus", "left").fillna(0.0, ["h1", "h2", "z"])
    ratio = F.when(F.col("h1") > 1e-9, F.col("h2") / F.col("h1")).otherwise(0.0)
    return out.withColumn("header_share", F.col("n_header") / (F.col("n_header") + F.col("n_lines"))).withColumn("ratio", ratio)


def ledger_invariants(stats: DataFrame) -> DataFrame:
    """``stats`` with the four invariants and whether all hold."""
    tests = (F.col("n_header_numerals") == 0, (F.col("n_header") > 0) & (F.col("header_share") <= HEADER_SHARE), F.col("ratio") < PREDICTABLE, F.col("z") < LOCKED)
    out = stats.withColumns(dict(zip(INVARIANTS, tests, strict=True)))
    return out.withColumn("all_hold", F.expr(" and ".join(INVARIANTS)))


def compare_ledgers(judged: DataFrame, first: str) -> DataFrame:
    """Each other corpus against ``first``: differences of header share, numeral entropies and z, and how many invariants come out alike."""
    a = judged.filter(F.col("corpus") == first).select(*[F.col(c).alias(f"a_{c}") for c in judged.columns])
    both = judged.filter(F.col("corpus") != first).crossJoin(F.broadcast(a))  # one row
    alike = sum(((F.col(i) == F.col(f"a_{i}")).cast("int") for i in INVARIANTS), F.lit(0))
    return both.select("corpus", *[(F.col(c) - F.col(f"a_{c}")).alias(f"{c}_diff") for c in ("header_share", "h1", "h2", "z")], alike.alias("n_alike"))
