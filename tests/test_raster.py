"""Raster work in tiles against plain loops over whole rasters, tile edges included."""

import math
import random

import numpy as np
import pytest

from structlab.operators import raster


def rows_of(spark, grids, kind="double"):
    cells = [(g, r, c, float(v)) for g, a in grids.items() for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(cells, "g int, r int, c int, v double").selectExpr("g", "r", "c", f"cast(v as {kind}) as v").repartition(3)


def grid_of(rows, shape, column="v"):
    out = np.full(shape, np.nan)
    for x in rows:
        out[x.r, x.c] = x[column]
    return out


def noise(shape, seed, levels=9):
    return np.random.default_rng(seed).integers(0, levels, shape).astype(float)


def disc(radius):
    return [(d, e) for d in range(-radius, radius + 1) for e in range(-round(math.sqrt(radius * radius - d * d)), round(math.sqrt(radius * radius - d * d)) + 1)]


def extreme(a, radius, op):
    h, w = a.shape
    return np.array([[op(a[r + d, c + e] for d, e in disc(radius) if 0 <= r + d < h and 0 <= c + e < w) for c in range(w)] for r in range(h)])


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_open_and_close(spark, radius):
    grids = {1: noise((23, 17), radius), 2: noise((5, 31), 9)}
    df = rows_of(spark, grids)
    opened, closed = raster.morph_open(df, ["g"], radius, tile=8).collect(), raster.morph_close(df, ["g"], radius, tile=8).collect()
    both = raster.morph_clean(df, ["g"], radius, 1, tile=8).collect()
    for g, a in grids.items():
        want = extreme(extreme(a, radius, min), radius, max)
        assert (grid_of([x for x in opened if x.g == g], a.shape) == want).all()
        assert (grid_of([x for x in closed if x.g == g], a.shape) == extreme(extreme(a, radius, max), radius, min)).all()
        assert (grid_of([x for x in both if x.g == g], a.shape) == extreme(extreme(want, 1, max), 1, min)).all()
    assert raster.morph_clean(df, ["g"], 0, 0).count() == df.count()


def test_running_extreme_at_all_widths():
    a = noise((4, 29), 2, 1000)
    for half in range(0, 40):
        got = raster.running_extreme(a, half, 1, True)
        assert (got == np.array([[row[max(0, c - half) : c + half + 1].max() for c in range(29)] for row in a])).all()


@pytest.mark.parametrize("kind,block", [("mean", 5), ("gaussian", 7), ("gaussian", 4), ("mean", 21)])
def test_adaptive_threshold(spark, kind, block):
    grids = {1: noise((19, 26), block, 200), 2: noise((3, 9), 4, 200)}
    got = raster.adaptive_threshold(rows_of(spark, grids), ["g"], block, 5.3, kind, tile=8).collect()
    half = (block | 1) // 2
    w = raster.weights(block | 1, kind)
    for g, a in grids.items():
        padded = np.pad(a, half, mode="edge")
        mean = np.array([[w @ padded[r : r + 2 * half + 1, c : c + 2 * half + 1] @ w for c in range(a.shape[1])] for r in range(a.shape[0])])
        assert (grid_of([x for x in got if x.g == g], a.shape) == (a > mean - 5.3)).all()


def test_sobel_and_swirl(spark):
    y, x = np.mgrid[0:40, 0:40]
    turn = np.round(100 + 100 * np.sin(3 * np.arctan2(y - 20, x - 20)))
    grids = {1: noise((13, 22), 5, 250), 2: turn, 3: 200 - turn}
    df = rows_of(spark, grids)
    got = raster.sobel(df, ["g"], tile=8).collect()
    for g, a in grids.items():
        p = np.pad(a, 1, mode="reflect")
        h, w = a.shape
        gx = sum(k * (p[1 + d : 1 + d + h, 2:] - p[1 + d : 1 + d + h, :-2]) for d, k in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(k * (p[2:, 1 + d : 1 + d + w] - p[:-2, 1 + d : 1 + d + w]) for d, k in ((-1, 1), (0, 2), (1, 1)))
        mine = [x for x in got if x.g == g]
        assert (grid_of(mine, a.shape, "gx") == gx).all() and (grid_of(mine, a.shape, "gy") == gy).all()
        mag, dx, dy = np.sqrt(gx * gx + gy * gy) + 1e-6, np.arange(w)[None, :] - w / 2, np.arange(h)[:, None] - h / 2
        radius = np.sqrt(dx * dx + dy * dy)
        along, ring = (gy * dx - gx * dy) / (radius + 1e-6), np.floor(radius / (radius.max() + 1e-6) * 3)
        rings = {x.ring: x for x in raster.swirl(df.filter(f"g = {g}"), ["g"], 3, tile=8).collect()}
        for k in range(3):
            some = (ring == k) & (mag > np.quantile(mag, 0.6))
            assert k not in rings if not some.any() else rings[k].mean_tangential == pytest.approx(np.average(along[some], weights=mag[some]))
    votes = spark.createDataFrame([(1, "ccw"), (1, "ccw"), (1, "cw"), (2, "cw"), (2, "ccw")], "g int, sense string")
    assert {v.g: v.sense for v in raster.swirl_vote(votes, ["g"]).collect()} == {1: "ccw", 2: "cw"}


def flood(a):
    label = {}
    h, w = a.shape
    for start in zip(*np.nonzero(a), strict=True):
        if start in label:
            continue
        label[start], stack = start, [start]
        while stack:
            r, c = stack.pop()
            for d in (-1, 0, 1):
                for e in (-1, 0, 1):
                    n = (r + d, c + e)
                    if 0 <= n[0] < h and 0 <= n[1] < w and a[n] and n not in label:
                        label[n] = start
                        stack.append(n)
    return label


@pytest.mark.parametrize("share", [0.2, 0.4, 0.7])
def test_components_are_those_of_a_flood(spark, share):
    r = np.random.default_rng(int(share * 10))
    grids = {1: (r.random((37, 29)) < share).astype(float), 2: (r.random((16, 16)) < share).astype(float), 3: np.zeros((9, 9))}
    snake = np.zeros((24, 24))
    snake[::4] = 1
    snake[[1, 2, 3, 9, 10, 11, 17, 18, 19], -1] = 1
    snake[[5, 6, 7, 13, 14, 15], 0] = 1
    grids[4] = snake
    labels = raster.components8(rows_of(spark, grids, "int"), ["g"], tile=8)
    got = {(x.g, x.r, x.c): (x.label >> 32, x.label & 0xFFFFFFFF) for x in labels.collect()}
    want = {(g, *at): first for g, a in grids.items() for at, first in flood(a).items()}
    assert got == {tuple(map(int, k)): tuple(map(int, v)) for k, v in want.items()}
    scores = {x.g: x for x in raster.elongation_score(raster.component_shapes(labels, ["g"]), ["g"], 10).collect()}
    assert scores[4].n_components == 1 and scores[4].score == pytest.approx(24 / math.sqrt(snake.sum()))
    assert 3 not in scores


def test_lines_score_above_blobs(spark):
    line, blob = np.zeros((40, 40)), np.zeros((40, 40))
    line[np.arange(40), np.arange(40)] = 1
    blob[10:18, 10:18] = 1
    scores = {x.g: x.score for x in raster.elongation_score(raster.component_shapes(raster.components8(rows_of(spark, {1: line, 2: blob}), ["g"], 8), ["g"]), ["g"]).collect()}
    assert scores[1] == pytest.approx(40 / math.sqrt(40)) and scores[2] == pytest.approx(1.0)


def test_summed_area_and_window_means(spark):
    grids = {1: noise((21, 18), 3), 2: noise((4, 40), 8)}
    df = rows_of(spark, grids)
    sums = raster.summed_area(df, ["g"], tile=8)
    rows = sums.collect()
    r = random.Random(2)
    spots = [(g, r.randint(-3, a.shape[0] + 3), r.randint(-3, a.shape[1] + 3), k) for g, a in grids.items() for k in range(80)]
    points = spark.createDataFrame(spots, "g int, r long, c long, k int")
    for g, a in grids.items():
        assert (grid_of([x for x in rows if x.g == g], a.shape, "s") == a.cumsum(0).cumsum(1)).all()
    for half in (1, 3):
        for x in raster.window_means(points, sums, raster.extents(df, ["g"]), ["g"], half).collect():
            a = grids[x.g]
            if 0 <= x.r < a.shape[0] and 0 <= x.c < a.shape[1]:
                assert x["mean"] == pytest.approx(a[max(0, x.r - half) : x.r + half + 1, max(0, x.c - half) : x.c + half + 1].mean())
            else:
                assert x["mean"] is None


def test_empty_rasters(spark):
    none = rows_of(spark, {1: np.zeros((1, 1))}).filter("false")
    assert raster.components8(none, ["g"]).count() == 0 and raster.morph_open(none, ["g"], 1).count() == 0 and raster.summed_area(none, ["g"]).count() == 0


def test_masks(spark):
    dark = np.full((12, 12), 20.0)
    dark[3:6, 2:5] = 200
    light = 220 - dark
    df = rows_of(spark, {1: dark, 2: light}, "int")
    got = raster.minority(raster.otsu(df, ["g"]), ["g"]).collect()
    for g in (1, 2):
        assert (grid_of([x for x in got if x.g == g], dark.shape) == (dark > 100)).all()
