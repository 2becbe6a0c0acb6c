"""Quality rules: a learned decision list (DataFrame functions only).

Text statistics are native columns.  Sequential covering over labelled
statistics grows conjunctions of thresholds and prunes them on held-out rows;
the list becomes one ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlab.llm.common import NOT_SPACE, SPACE, Scratch

#: Labelled rows that the list is fitted on, in expectation; a hash of the id picks them.
SAMPLE_ROWS = 20_000
WINDOW = 5
#: Percentiles of either class that serve as thresholds.
CUTS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99, 0.995)
#: Features that rules may test, all shares or counts of a whole text.
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "mark_share", "bar_share", "dup_line_share", "repeat_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the array.

    Windows are compared by 64-bit hashes of their words.  Only texts in which
    a window repeats sort their windows; a repeated window then covers the
    words up to the next repeated window, ``window`` at most.
    """

    def covered(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws) - (window - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(window)]))

        def from_hashes(hs: Column) -> Column:
            placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
            twice = lambda s: F.sort_array(
                F.transform(F.filter(s, lambda x, i: same(s, i, i - 1) | same(s, i, i + 1)), lambda x: x["i"])
            )
            spans = lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
                lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")),
                lambda a: a["n"],
            )
            counted = F.transform(F.transform(F.array(placed), twice), spans)[0]
            return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(counted)

        return F.transform(F.array(hashes), from_hashes)[0]

    return F.when(F.size(words) < window, F.lit(0)).otherwise(covered(words)).cast("long")


def text_statistics(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``keep`` plus the base counts and ``FEATURES`` of each whole text (null: none)."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(*[F.col(c) for c in keep], body.alias("__body"))
    rows = rows.select(*keep, "__body", F.filter(F.split("__body", SPACE), lambda w: w != "").alias("__words"))
    lines = F.filter(F.split("__body", "\n"), lambda x: x.rlike(NOT_SPACE))
    measured = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.regexp_replace("__body", r"[^A-Z0-9!?|]+", "").alias("__kept"),
    )
    # A generator is a barrier: filters on its output aren't pushed below, where they would count every text again.
    counts = rows.select(*keep, F.inline(F.array(measured)))
    sized = lambda pattern: F.char_length(F.regexp_replace("__kept", pattern, "")).cast("double")
    chars, n = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    n_lines = F.size("__lines")
    dup = (n_lines - F.size(F.array_distinct("__lines"))).cast("long")
    counts = counts.select("*", dup.alias("n_dup_lines"), n_lines.alias("__n_lines"))
    return counts.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbol_share"),
        (sized("[^A-Z]+") / chars).alias("upper_share"),
        (sized("[^0-9]+") / chars).alias("digit_share"),
        (sized("[^!?]+") / n).alias("mark_share"),
        (sized("[^|]+") / n).alias("bar_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit_rules(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.95,
) -> list[list[Condition]]:
    """Rules for label 0, in order; a row that meets every condition of a rule is rejected.

    At most about ``sample_rows`` labelled rows are used.  Their statistics are
    cut at class percentiles and counted per combination of bins, so the
    learner sees counts of labelled rows, not texts.  Two thirds of the rows
    (by a hash of the id) grow a conjunction by FOIL gain; the rest prune its
    last conditions and decide, by ``precision``, whether the rule joins the
    list.  Null labels are left out; of several labels the highest counts.
    Without labels of both classes there are no rules.
    """
    work = Scratch(df.sparkSession, "quality-rules")
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).dropna()
    known = known.groupBy("__id").agg(F.max("__label").cast("int").alias("__label"))
    total = known.count()
    share = int(min(1.0, sample_rows / max(total, 1)) * (1 << 30))
    known = known.filter(F.pmod(F.xxhash64(F.col("__id"), F.lit("sample")), F.lit(1 << 30)) < share)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id")
    stats = text_statistics(rows, "__text", ("__id", "__label")).filter(~base_failed())
    stats = work.save(stats.select("__id", (F.col("__label") == 0).alias("bad"), *[F.col(f).cast("double").alias(f) for f in FEATURES]), "stats")
    quantiles = stats.groupBy("bad").agg(*[F.percentile_approx(f, list(CUTS), 10_000).alias(f) for f in FEATURES]).collect()
    if len(quantiles) < 2:
        return []
    cuts = {f: sorted({x for q in quantiles for x in q[f]}) for f in FEATURES}
    bins = [sum((F.when(F.col(f) > F.lit(c), 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]
    grows = (F.pmod(F.xxhash64(F.col("__id"), F.lit("grow")), F.lit(3)) > 0).alias("grows")
    cells = stats.select("bad", grows, *bins).groupBy("bad", "grows", *FEATURES).count().collect()
    cells.sort(key=tuple)
    return cover([(c["bad"], c["grows"], tuple(c[f] for f in FEATURES), c["count"]) for c in cells], cuts, max_rules, max_conditions, precision)


def cover(cells: list, cuts: dict, max_rules: int, max_conditions: int, precision: float) -> list[list[Condition]]:
    """Sequential covering over counted cells (bad, grows, bin codes, count)."""

    def tally(part, tests):
        p = sum(c[3] for c in part if c[0] and meets(c[2], tests))
        return p, sum(c[3] for c in part if not c[0] and meets(c[2], tests))

    def meets(codes, tests):
        return all((codes[k] > b) == above for k, above, b in tests)

    rules = []
    while len(rules) < max_rules:
        grow, prune = [c for c in cells if c[1]], [c for c in cells if not c[1]]
        part, tests = grow, []
        while len(tests) < max_conditions:
            p0, n0 = tally(part, [])
            if not p0 or not n0:
                break
            best = None
            for k, f in enumerate(FEATURES):
                size = len(cuts[f]) + 1
                pos, neg = [0] * size, [0] * size
                for bad, _, codes, n in part:
                    (pos if bad else neg)[codes[k]] += n
                p, n = 0, 0
                for b in range(size - 1):
                    p, n = p + pos[b], n + neg[b]
                    for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                        if p1:
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, (k, above, b))
            if best is None:
                break
            tests.append(best[1])
            part = [c for c in part if meets(c[2], [best[1]])]
        if not tests:
            break

        def worth(t):
            p, n = tally(prune, t)
            return (p - n) / (p + n) if p + n else -1.0

        tests = max((tests[:i] for i in range(1, len(tests) + 1)), key=lambda t: (worth(t), -len(t)))
        (p, n), (gp, gn) = tally(prune, tests), tally(grow, tests)
        if not p or p < precision * (p + n) or gp < precision * (gp + gn):
            break
        rules.append([Condition(FEATURES[k], above, cuts[FEATURES[k]][b]) for k, above, b in tests])
        cells = [c for c in cells if not meets(c[2], tests)]
    return rules


def rule_column(rules: list[list[Condition]]) -> Column:
    """Number (from 1) of the first rule that a row meets, 0 if none; an ordered conditional expression."""
    out = None
    for k, tests in enumerate(rules, 1):
        holds = F.lit(True)
        for t in tests:
            holds = holds & t.column()
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def apply_rules(df: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, base counts, base_failed, rule and kept for each row of ``df``; no shuffle."""
    stats = text_statistics(df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("__text")), "__text", ("row_id",))
    judged = stats.select("*", base_failed().alias("base_failed"), rule_column(rules).cast("int").alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
