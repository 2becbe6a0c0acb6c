"""Range counts of log distances against all pairs."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from structlab.functions.ratio import DIATONIC
from structlab.operators import tolerance


def off(a, b):
    d = abs(a - b) % 1.0
    return min(abs(d - math.log2(v)) * 1200 for _, v in DIATONIC)


@pytest.mark.parametrize("tile_values", [7, 50, 4096])
def test_note_hits_are_those_of_all_pairs(spark, tile_values):
    r = random.Random(3)
    rows = [(t, r.uniform(-6, 9)) for t in range(3) for _ in range([150, 60, 1][t])]
    rows += [(0, 2.25)] * 40 + [(0, 3.25)] * 5 + [(1, 0.5)] * 3
    df = spark.createDataFrame(rows, "g int, y double")
    tols = (5.0, 20.0, 60.0)
    got = {(x.g, x.tol): x.n_hits for x in tolerance.note_hits(df, ["g"], "y", tols, tile_values).collect()}
    for g in range(3):
        ys = [y for k, y in rows if k == g]
        offs = [off(a, b) for i, a in enumerate(ys) for b in ys[:i]]
        for t in tols:
            assert got.get((g, t), 0) == sum(o <= t for o in offs)


def test_sweep_flags_a_null_that_cannot_vary(spark):
    rows = spark.range(40).select(F.col("id"), F.pow(F.lit(1.37), F.col("id") % 23).alias("v"))
    known = spark.createDataFrame([], "a long, b long")
    out = {x.tol: x for x in tolerance.tolerance_sweep(rows, "id", "v", known, "s", 12, n_bootstraps=6, multiplier=3).collect()}
    assert sorted(out) == sorted(tolerance.TOLERANCES)
    assert all(x.degenerate and x.perm_max == x.hits_filt == x.hits_all and x.perm_spread == 0 for x in out.values())
    assert out[10.0].n_pairs == 40 * 39 // 2
    assert out[50.0].hits_all >= out[10.0].hits_all


def test_sweep_keeps_within_its_bar(spark):
    rows = spark.range(22).select(F.col("id"), F.exp(F.col("id") * 0.731).alias("v"))
    known = spark.createDataFrame([(0, 3), (2, 9)], "a long, b long")
    tolerance.tolerance_sweep(rows, "id", "v", known, "warm", 2, n_bootstraps=2).collect()
    began = time.time()
    assert tolerance.tolerance_sweep(rows, "id", "v", known, "s", 50).count() == 7
    assert time.time() - began < 10


def test_note_shares_are_those_of_all_pairs(spark):
    r = random.Random(5)
    values = [r.randint(1, 9000) / 100 for _ in range(120)] + [10.0, 20.0, 40.0, 20.0, 30.0]
    df = spark.createDataFrame([(0, math.log2(v)) for v in values], "g int, y double")
    got = {x.note: (x.n_pairs, x.n_hits) for x in tolerance.note_shares(df, ["g"], "y", 20.0).collect()}
    want = {n: [0, 0] for n, _ in DIATONIC}
    for i, a in enumerate(values):
        for b in values[:i]:
            ratio = max(a, b) / min(a, b)
            folded = ratio / 2 ** math.floor(math.log2(ratio))
            off, k = min((abs(1200 * math.log2(folded / v)), k) for k, (_, v) in enumerate(DIATONIC))
            want[DIATONIC[k][0]][0] += 1
            want[DIATONIC[k][0]][1] += off <= 20.0
    assert got == {n: tuple(v) for n, v in want.items()}


def test_note_shares_judge_octaves_as_the_arithmetic_does(spark):
    r = random.Random(11)
    low = [(r.randint(1, 250_000) / 100 + 1000) / 100 for _ in range(150)]
    balances = [round(v * 100 - 1000, 2) for v in low] + [round(2 * v * 100 - 1000, 2) for v in low]
    values = [(b + 1000) / 100 for b in balances]
    df = spark.createDataFrame([(0, v, math.log2(v)) for v in values], "g int, v double, y double")
    got = {x.note: (x.n_pairs, x.n_hits) for x in tolerance.note_shares(df, ["g"], "y", 20.00005, "v").collect()}
    want, just_below = {n: [0, 0] for n, _ in DIATONIC}, 0
    for i, a in enumerate(values):
        for b in values[:i]:
            ratio = max(a, b) / min(a, b)
            folded = ratio / 2 ** math.floor(math.log2(ratio))
            offs = [abs(1200 * math.log2(folded / v)) for _, v in DIATONIC]
            k = min((round(o, 6), k) for k, o in enumerate(offs))[1]
            just_below += 2 - 1e-12 < ratio < 2
            want[DIATONIC[k][0]][0] += 1
            want[DIATONIC[k][0]][1] += round(min(offs), 4) <= 20
    assert just_below > 5
    assert got == {n: tuple(v) for n, v in want.items()}


def test_tiles_grow_with_a_group_instead_of_in_number(spark, monkeypatch):
    df = spark.range(70_000).select(F.lit(0).alias("g"), (F.rand(4) * 5).alias("y")).localCheckpoint()
    written, settled = [], tolerance.settled
    monkeypatch.setattr(tolerance, "settled", lambda rows: written.append(out := settled(rows)) or out)
    got = sorted(tolerance.note_hits(df, ["g"], "y", (5.0, 20.0)).collect())
    assert max(w.count() for w in written if "__tile" in w.columns) <= 8
    assert got == sorted(tolerance.note_hits(df, ["g"], "y", (5.0, 20.0), 4096).collect())
