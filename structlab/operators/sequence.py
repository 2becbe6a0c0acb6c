"""Statistics of token sequences.

Input rows have a sequence, an order within it and a token; ``by`` names extra
grouping columns (a corpus, a trial).  Null tokens are unreadable and dropped.
Windows are partitioned by sequence, so no corpus passes through one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structlab.shared import settled


def explode_tokens(df: DataFrame, id_col: str, tokens_col: str, *keep: str) -> DataFrame:
    """(seq, ord, token) from an array column; null tokens are dropped."""
    out = df.select(*keep, F.col(id_col).alias("seq"), F.posexplode(tokens_col).alias("ord", "token"))
    return out.filter("token is not null")


def token_counts(df: DataFrame, by: list[str], token: str = "token") -> DataFrame:
    return df.groupBy(*by, token).agg(F.count("*").alias("c"))


def unigram_entropy(df: DataFrame, by: list[str] = (), token: str = "token") -> DataFrame:
    """Per group: n, kinds, entropy in bits, index of coincidence and the share of the largest possible entropy.

    log2 n - sum(c log2 c) / n is the entropy from counts alone: one pass over
    counts, no join with the total.
    """
    by = list(by)
    counts = token_counts(df, by, token)
    n = F.sum("c")
    entropy = F.log2(n.cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / n
    pairs = (n * (n - 1)).cast("double")
    return counts.groupBy(*by).agg(
        n.cast("long").alias("n_tokens"),
        F.count("*").alias("n_kinds"),
        entropy.alias("entropy"),
        (F.sum(F.col("c") * (F.col("c") - 1)) / F.nullif(pairs, F.lit(0.0))).alias("ioc"),
        (entropy / F.nullif(F.log2(F.count("*").cast("double")), F.lit(0.0))).alias("share_of_max"),
    )


def bigrams(df: DataFrame, by: list[str] = (), seq: str = "seq", order: str | list[str] = "ord", token: str = "token", cross: bool = False) -> DataFrame:
    """Neighbouring pairs (x, y) within sequences; with ``cross`` also from each sequence's last token to the next one's first.

    The crossing pairs come from one row per sequence (first and last token),
    so only those rows are ordered as a whole.
    """
    by, order = list(by), [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*by, seq).orderBy(*order)
    inside = df.select(*by, F.col(token).alias("x"), F.lead(token).over(w).alias("y")).filter("y is not null")
    if not cross:
        return inside
    place = F.struct(*order)
    ends = df.groupBy(*by, seq).agg(F.min_by(token, place).alias("first"), F.max_by(token, place).alias("last"))
    across = ends.select(*by, F.col("last").alias("x"), F.lead("first").over(Window.partitionBy(*by).orderBy(seq)).alias("y"))
    return inside.unionByName(across.filter("y is not null"))


def conditional_entropy(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """H(next | previous) in bits; the previous token's total counts only tokens that have a next."""
    by = list(by)
    counted = "c" in pairs.columns  # pairs that come with their counts
    joint = pairs if counted else pairs.groupBy(*by, "x", "y").agg(F.count("*").alias("c"))
    rows = joint.groupBy(*by, "x").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"))
    value = F.sum(F.col("n") * F.log2(F.col("n").cast("double")) - F.col("s")) / F.sum("n")
    return rows.groupBy(*by).agg(F.sum("n").cast("long").alias("n_pairs"), value.alias("cond_entropy"))


def top_bigrams(pairs: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """The ``k`` most frequent pairs; ties by the pair itself."""
    by = list(by)
    counts = pairs.groupBy(*by, "x", "y").agg(F.count("*").alias("c"))
    if not by:
        return counts.orderBy(F.desc("c"), "x", "y").limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc("c"), "x", "y")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Most n-grams that are broadcast to be counted by their text.
NGRAM_BOUND = 100_000


def common_ngrams(df: DataFrame, tokens_col: str, id_col: str, n: int, least: int = 2, top: int = 20) -> DataFrame:
    """n-grams in at least ``least`` sequences: n-gram, count, sequences; the ``top`` by sequences, count, n-gram.

    Where no id repeats, n-grams are counted by 64-bit hashes first, combined before the shuffle; equal hashes can only raise a
    count, so those that reach the counts of the last of the ``top`` hold the answer and are counted again by their text.
    """
    starts = F.when(F.size(tokens_col) >= n, F.sequence(F.lit(1), F.size(tokens_col) - (n - 1))).otherwise(F.array().cast("array<int>"))
    texts = F.transform(starts, lambda i: F.array_join(F.slice(tokens_col, i, F.lit(n)), " "))
    exact = lambda grams: grams.groupBy("ngram", "seq").agg(F.count("*").alias("c")).groupBy("ngram").agg(F.sum("c").alias("n_total"), F.count("*").alias("n_seqs")).filter(F.col("n_seqs") >= least)
    ranked = lambda rows: rows.orderBy(F.desc("n_seqs"), F.desc("n_total"), "ngram").limit(top)
    grams = df.select(F.col(id_col).alias("seq"), F.explode(texts).alias("ngram"))
    if not df.groupBy(id_col).count().filter(f"count > 1 or `{id_col}` is null").isEmpty():
        return ranked(exact(grams))
    hashes = df.select(F.sort_array(F.transform(texts, lambda t: F.xxhash64(t))).alias("h"))
    marked = hashes.select(F.explode(F.transform("h", lambda h, i: F.struct(h.alias("h"), ((i == 0) | (F.get("h", i - 1) != h)).alias("new")))).alias("m"))
    counts = settled(marked.groupBy("m.h").agg(F.count("*").alias("n_total"), F.count_if("m.new").alias("n_seqs")).filter(F.col("n_seqs") >= least))
    low = None
    while True:
        order = counts.orderBy(F.desc("n_seqs"), F.desc("n_total")).limit(top).collect()  # ``top`` rows
        bound = low or ((order[-1].n_seqs, order[-1].n_total) if len(order) == top else (least, 0))
        held = counts.filter((F.col("n_seqs") > bound[0]) | ((F.col("n_seqs") == bound[0]) & (F.col("n_total") >= bound[1]))).select("h")
        held = held.hint("broadcast" if held.limit(NGRAM_BOUND + 1).count() <= NGRAM_BOUND else "merge")
        out = settled(ranked(exact(grams.withColumn("h", F.xxhash64("ngram")).join(held, "h", "left_semi"))))
        found = out.collect()  # ``top`` rows
        last = min(((r.n_seqs, r.n_total) for r in found), default=(least, 0)) if len(found) == top else (least, 0)
        if len(order) < top or last >= bound:
            return ranked(out)
        low = last  # two texts share a hash


def repeat_structure(df: DataFrame, by: list[str], item: str, order: str, least: int = 2) -> DataFrame:
    """Items that recur: count, first and last place, mean gap and its coefficient of variation, and a layout class."""
    w = Window.partitionBy(*by, item).orderBy(order)
    gaps = df.withColumn("gap", (F.col(order) - F.lag(order).over(w)).cast("double"))
    out = gaps.groupBy(*by, item).agg(
        F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.avg("gap").alias("gap_mean"), F.stddev_pop("gap").alias("gap_sd")
    )
    out = settled(out.filter(F.col("n") >= least).withColumn("gap_cv", F.col("gap_sd") / F.nullif(F.col("gap_mean"), F.lit(0.0))))
    # On a limit of the classes the last bit decides: there the deviation is summed up in the order of the places.
    edge = out.filter("n > 2 and (abs(gap_cv - 0.25) < 1e-9 or abs(gap_cv - 1) < 1e-9)").select(*[F.col(c).alias(f"__{c}") for c in [*by, item]])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, item]]
    ordered = df.join(edge, on, "left_semi").groupBy(*[F.col(c).alias(f"__{c}") for c in [*by, item]]).agg(F.array_sort(F.collect_list(order)).alias("__at"))
    steps = F.transform(F.sequence(F.lit(1), F.size("__at") - 1), lambda i: (F.col("__at")[i] - F.col("__at")[i - 1]).cast("double"))
    ordered = ordered.select(*[f"__{c}" for c in [*by, item]], running_deviation(steps).alias("__sd"))
    cv = F.coalesce("__sd", "gap_sd") / F.nullif(F.col("gap_mean"), F.lit(0.0))
    out = out.join(ordered, on, "left").withColumn("__cv", cv)
    layout = F.when(F.col("n") < 3, "pair").when(F.col("__cv") <= 0.25, "regular").when(F.col("__cv") >= 1, "clustered").otherwise("scattered")
    return out.withColumn("layout", layout).drop("__cv", "__sd", *[f"__{c}" for c in [*by, item]])


def running_deviation(values: Column) -> Column:
    """Standard deviation of an array's numbers by a running mean and a running sum of squares, one number after the other."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("squares"))

    def add(s, x):
        n = s["n"] + 1.0
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    return F.aggregate(values, start, add, lambda s: F.sqrt(s["squares"] / s["n"]))


def lz78_count(tokens: Iterable) -> int:
    """Phrases of the LZ78 parse, by a trie whose edges are keyed by (node, token); an unfinished last phrase doesn't count."""
    trie: dict = {}
    node = phrases = 0
    for t in tokens:
        after = trie.get((node, t))
        if after is None:
            phrases += 1
            trie[node, t] = phrases
            node = 0
        else:
            node = after
    return phrases


def lz76_count(s: Sequence) -> int:
    """Phrases of the exhaustive history of a sequence: each is the shortest that didn't begin earlier.

    A suffix automaton grows by one symbol per step while the phrase is followed
    in it, so the cost is linear in the length.
    """
    step: list[dict] = [{}]
    link, length = [-1], [0]
    last = at = size = phrases = 0
    for symbol in s:
        # The phrase with this symbol occurred before iff the automaton of all symbols before has that edge.
        after = step[at].get(symbol)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in step[p]:
            step[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = step[p][symbol]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(symbol) == q:
                    step[p][symbol] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
        if after is None:
            phrases, at, size = phrases + 1, 0, 0
        else:
            at, size = after, size + 1
            while length[link[at]] >= size:  # a split left the phrase in the shorter state
                at = link[at]
    return phrases + (size > 0)


def lz78_phrases(tokens: Column) -> Column:
    """Phrases of the LZ78 parse of each array of tokens; null has none.  A parse is sequential, so a text is one row's work."""

    @F.pandas_udf(T.LongType())
    def parse(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: 0 if r is None else lz78_count(r)).astype("int64")

    return parse(tokens)


def lz76_phrases(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_phrases): exhaustive-history parse of each text; null has none."""

    @F.pandas_udf(T.LongType())
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: lz76_count(s or "")).astype("int64")

    return df.select(id_col, parse(F.col(text_col)).alias("n_phrases"))


def window_profile(df: DataFrame, id_col: str, text_col: str, window: int, step: int) -> DataFrame:
    """(id, start, entropy) of sliding windows over characters; the tail that fills no window is dropped."""
    n = F.length(text_col)
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1), F.lit(step)))
    parts = df.select(id_col, F.explode(starts).alias("start"), F.col(text_col).alias("t"))
    chars = parts.select(id_col, "start", F.explode(F.split(F.substring(F.col("t"), F.col("start"), F.lit(window)), "")).alias("ch")).filter("ch <> ''")
    return unigram_entropy(chars, [id_col, "start"], "ch").select(id_col, "start", "entropy")


def jaccard_sets(a: Column, b: Column) -> Column:
    """Share of common members of two arrays; two empty ones are equal."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def spearman_closed(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) over mean ranks of ties (not the correlation of ranks)."""
    by = list(by)

    def rank(c: str) -> Column:
        low = F.rank().over(Window.partitionBy(*by).orderBy(c))
        return low + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0

    ranked = df.select(*by, F.pow(rank(x) - rank(y), F.lit(2.0)).alias("d2"))
    n = F.count("*").cast("double")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), (1.0 - 6.0 * F.sum("d2") / F.nullif(n * (n * n - 1.0), F.lit(0.0))).alias("rho"))


def numeral_blocks(df: DataFrame, by: list[str], order: str, is_numeral: Column) -> DataFrame:
    """Runs of numerals as islands: start, end, length."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumn("__num", is_numeral).withColumn("__rn", F.row_number().over(w))
    islands = marked.filter("__num").withColumn("__island", F.col("__rn") - F.row_number().over(w))
    return islands.groupBy(*by, "__island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("__island")


def split_header(df: DataFrame, by: list[str], order: str, is_numeral: Column) -> DataFrame:
    """Adds ``header``: whether a token stands before its sequence's first numeral."""
    first = F.min(F.when(is_numeral, F.col(order))).over(Window.partitionBy(*by))
    return df.withColumn("header", F.coalesce(F.col(order) < first, F.lit(True)))


def gini(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Gini coefficient: sum((2 rank - n - 1) v) / (n sum v)."""
    by = list(by)
    ranked = df.select(*by, F.col(value).cast("double").alias("v"), F.row_number().over(Window.partitionBy(*by).orderBy(value)).alias("r"))
    n = F.count("*").cast("double")
    return ranked.groupBy(*by).agg(((2.0 * F.sum(F.col("r") * F.col("v")) - (n + 1.0) * F.sum("v")) / F.nullif(n * F.sum("v"), F.lit(0.0))).alias("gini"))
