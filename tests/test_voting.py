"""Votes for lines and circles, spiral and lattice readings, and containment joins against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlab.operators import hough, joins, spiral


def points_of(spark, cells):
    return spark.createDataFrame([(g, int(r), int(c)) for g, r, c in cells], "g int, r int, c int").repartition(3)


def test_line_votes_and_peaks(spark):
    r = random.Random(4)
    cells = {(1, k, 5 + k) for k in range(40)} | {(1, 30, c) for c in range(0, 60, 2)} | {(2, r.randrange(50), r.randrange(50)) for _ in range(60)} | {(3, k, 0) for k in range(30)}
    votes = hough.line_votes(points_of(spark, cells), ["g"])
    want = Counter()
    for g, y, x in cells:
        for k in range(180):
            c, s = hough.direction(k, 180)
            want[g, k, (x * c + y * s + 32768) >> 16] += 1
    assert {(v.g, v.theta, v.rho): v.votes for v in votes.collect()} == want
    got = {(v.g, v.theta, v.rho) for v in hough.local_peaks(votes, ["g"], 15).collect()}
    strong = {k: n for k, n in want.items() if n >= 15}

    def beaten(key):
        g, t, p = key
        for i in range(-2, 3):
            for j in range(-2, 3):
                if i or j:
                    a, b = t + i, p + j
                    other = (g, a % 180, b if 0 <= a < 180 else -b)
                    if other in strong and (strong[other], -other[1], -other[2]) > (strong[key], -t, -p):
                        return True
        return False

    assert got == {k for k in strong if not beaten(k)}
    assert {(1, 90, 30), (3, 0, 0)} <= got and any(g == 1 and abs(t - 135) <= 1 and p in (-3, -4) for g, t, p in got)


def test_circles_found(spark):
    r = random.Random(6)
    cells = {(1, 30 + a, 40 + b) for a, b in hough.ring(12, 64)} | {(1, 60 + a, 20 + b) for a, b in hough.ring(8, 64)} | {(1, r.randrange(90), r.randrange(90)) for _ in range(80)}
    found = hough.circles(points_of(spark, cells), ["g"], [6, 8, 10, 12, 14], 0.8).collect()
    assert {(x.radius, x.r, x.c) for x in found} == {(12, 30, 40), (8, 60, 20)}
    want = Counter((s, y - a, x - b) for _, y, x in cells for s in (8, 12) for a, b in hough.ring(s, 64))
    assert {(v.radius, v.r, v.c): v.votes for v in hough.circle_votes(points_of(spark, cells), ["g"], [8, 12]).collect()} == want


def test_lines_are_told_from_noise(spark):
    r = np.random.default_rng(12)
    rows = []
    for k in range(24):
        a = r.normal(120, 12, (48, 48))
        if k < 6:
            t = np.arange(48)
            a[t, (5 + k + t * (0.4 + 0.1 * k)).astype(int) % 48] += 120
        rows += [(k, "line" if k < 6 else "noise", y, x, float(v)) for (y, x), v in np.ndenumerate(np.clip(a.round(), 0, 255))]
    df = spark.createDataFrame(rows, "g int, kind string, r int, c int, v double")
    scores = hough.line_score(df, ["g", "kind"], tile=16)
    out = hough.calibrated(scores, "kind", "line").first()
    assert out.power == 1.0 and out.false_rate <= 1 / 18


def plain_spiral(a, cx, cy, outer, inner, n, turns, ccw, outward, theta):
    out = []
    for i in range(n):
        t = i / max(n - 1, 1)
        rad = inner * (1 - t) + outer * t if outward else outer * (1 - t) + inner * t
        at = theta + (1 if ccw else -1) * t * turns * 2 * math.pi
        x, y = round(cx + rad * math.cos(at)), round(cy + rad * math.sin(at))
        inside = 0 <= x < a.shape[1] and 0 <= y < a.shape[0]
        out.append(a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean() / 255 if inside else 0.0)
    return out


def test_planted_bits_come_back(spark):
    r = random.Random(9)
    bits, n = [0, 1] * 40, 80
    r.shuffle(bits)
    configs = spiral.sweep_grid(spark, (3, 4), (0.08, 0.18), 4)
    plan = [x.asDict() for x in configs.collect()]
    target = next(x for x in plan if x["turns"] == 4 and x["inner"] == 0.18 and x["outward"] and not x["ccw"] and x["theta"] > 1 and x["theta"] < 2)
    a = np.full((246, 258), 90.0)
    cx, cy, outer = 129, 123, 82
    for i, b in enumerate(bits):
        t = i / (n - 1)
        rad, at = outer * 0.18 * (1 - t) + outer * t, target["theta"] - t * 4 * 2 * math.pi
        x, y = round(cx + rad * math.cos(at)), round(cy + rad * math.sin(at))
        a[y - 1 : y + 2, x - 1 : x + 2] = 250 if b else 10
    cells = spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "g int, r int, c int, v double")
    known = spark.createDataFrame([("planted", k, b) for k, b in enumerate(bits)] + [("other", k, 1 - bits[k // 2]) for k in range(60)], "name string, bit int, on int")
    top = spiral.spiral_sweep(cells, ["g"], configs, known, n, 25, tile=32).collect()
    errors = {}
    for x in plan:
        read = plain_spiral(a, cx, cy, outer, outer * x["inner"], n, x["turns"], x["ccw"], x["outward"], x["theta"])
        on = [int(s >= float(np.median(read))) for s in read]
        own = {"planted": np.mean([o != b for o, b in zip(on, bits, strict=True)]), "other": np.mean([on[k] != 1 - bits[k // 2] for k in range(60)])}
        errors[x["cfg"], False] = round(min(own.values()) + 1e-12, 4)
        errors[x["cfg"], True] = round(min(1 - e for e in own.values()) + 1e-12, 4)
    want = sorted((e, *k) for k, e in errors.items())[:25]
    assert [(round(x.error, 4), x.cfg, x.invert) for x in top] == [(round(float(e), 4), k, i) for e, k, i in want]
    assert top[0].error == 0 and top[0].cfg == target["cfg"] and not top[0].invert and top[0].name == "planted"


def test_lattice(spark):
    a = np.random.default_rng(3).integers(0, 255, (40, 30)).astype(float)
    cells = spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "r int, c int, v double")
    got = {(x.gr, x.gc): x for x in spiral.sample_lattice(cells, (5, 3, 35, 27), 7, 5, tile=16).collect()}
    want = {}
    for i in range(7):
        for j in range(5):
            y, x = 5 + int((i + 0.5) * 30 / 7), 3 + int((j + 0.5) * 24 / 5)
            want[i, j] = a[y - 1 : y + 2, x - 1 : x + 2].mean() / 255
    assert {k: x["sample"] for k, x in got.items()} == pytest.approx(want)
    middle = float(np.median(list(want.values())))
    assert all(got[k].on == int(v >= middle) for k, v in want.items())


def test_containment_is_that_of_all_pairs(spark):
    r = random.Random(1)
    long = [(k, "".join(r.choice("01") for _ in range(r.randint(0, 14)))) for k in range(80)] + [(90, None), (91, "")]
    short = [(k, "".join(r.choice("01") for _ in range(r.randint(0, 6)))) for k in range(30)] + [(40, None)]
    a, b = spark.createDataFrame(long, "i int, body string"), spark.createDataFrame(short, "j int, part string")
    out = joins.containment_join(a, b, "body", "part")
    assert Counter((x.i, x.j) for x in out.collect()) == Counter((i, j) for i, t in long for j, p in short if t is not None and p and p in t)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    assert joins.containment_join(a, b.filter(F.lit(False)), "body", "part").count() == 0
