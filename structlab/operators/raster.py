"""Rasters as rows (by, r, c, v) that are worked on in square tiles.

Filters over neighbourhoods get each tile with a rim from its neighbours, in
one shuffle; components are labelled inside tiles and united across their
borders; sums over rectangles come from prefix sums with tile offsets.  A task
holds one tile at a time, never a raster.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structlab.operators.graph import connected_components
from structlab.shared import settled

TILE = 128


def extents(df: DataFrame, by: list[str]) -> DataFrame:
    """Height and width of each raster, from its largest row and column."""
    return df.groupBy(*by).agg((F.max("r") + 1).cast("long").alias("h"), (F.max("c") + 1).cast("long").alias("w"))


def source_index(at: np.ndarray, size: int, border: str) -> np.ndarray:
    """Which row or column stands for each index outside: the edge repeated, or mirrored without repeating the edge."""
    if border == "reflect" and size > 1:
        at = np.abs(at) % (2 * (size - 1))
        return np.where(at >= size, 2 * (size - 1) - at, at)
    return np.clip(at, 0, size - 1)


def filter_tiles(
    df: DataFrame, by: list[str], halo: int, work: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], out: str, border: str = "constant", fill: float = 0.0, tile: int = TILE
) -> DataFrame:
    """(by, r, c, the columns of ``out``) of every cell of each raster.

    ``work`` gets a tile with ``halo`` more cells on each side, and which of
    these lie in the raster; it returns arrays of that size, whose rims are cut
    off.  Cells outside are ``fill``, or stand for cells inside by ``border``
    (replicate, reflect); cells without a row are ``fill``.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in by}
    size = extents(df, by)
    cells = df.select(*by, *[F.col(x).cast("long").alias(x) for x in "rc"], F.col("v").cast("double").alias("v"))
    sized = cells.join(size, by) if by else cells.crossJoin(F.broadcast(size))  # one row
    tiles = lambda x, size: F.sequence(F.greatest(F.lit(0), F.floor((F.col(x) - halo) / tile)), F.least(F.floor((F.col(size) - 1) / tile), F.floor((F.col(x) + halo) / tile)))
    spread = sized.select("*", F.explode(tiles("r", "h")).alias("tr")).select("*", F.explode(tiles("c", "w")).alias("tc"))
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(side) - 1) / tile)))  # noqa: E731  tiles without a cell are worked on too
    bare = size.select(*by, *[F.lit(None).cast(k).alias(x) for x, k in (("r", "long"), ("c", "long"), ("v", "double"))], "h", "w", every("h").alias("tr")).select("*", every("w").alias("tc"))
    spread = spread.unionByName(bare)
    names = [part.split()[0] for part in out.split(",")]

    def one(rows: pa.Table) -> pa.Table:
        h, w, tr, tc = (rows[x][0].as_py() for x in ("h", "w", "tr", "tc"))
        r0, c0, side = tr * tile - halo, tc * tile - halo, tile + 2 * halo
        window = np.full((side, side), fill)
        heads = {b: rows[b][0].as_py() for b in by}
        fields = {b: rows.schema.field(b).type for b in by}
        rows = rows.filter(pc.is_valid(rows["r"]))
        window[rows["r"].to_numpy() - r0, rows["c"].to_numpy() - c0] = rows["v"].to_numpy()
        at_r, at_c = np.arange(r0, r0 + side), np.arange(c0, c0 + side)
        inside = ((at_r >= 0) & (at_r < h))[:, None] & ((at_c >= 0) & (at_c < w))[None, :]
        if border != "constant":
            from_r, from_c = source_index(at_r, h, border) - r0, source_index(at_c, w, border) - c0
            window = window[np.clip(from_r, 0, side - 1)][:, np.clip(from_c, 0, side - 1)]
        made = work(window, inside)
        keep = np.zeros_like(inside)
        keep[halo : halo + tile, halo : halo + tile] = True
        r, c = np.nonzero(inside & keep)
        columns = {b: pa.array([heads[b]] * len(r), fields[b]) for b in by}
        columns |= {"r": pa.array(r + r0), "c": pa.array(c + c0)} | {n: pa.array(made[n][r, c]) for n in names}
        return pa.table(columns)

    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "r long, c long", out])
    return spread.groupBy(*by, "tr", "tc").applyInArrow(one, schema)


def running_extreme(a: np.ndarray, half: int, axis: int, largest: bool) -> np.ndarray:
    """Extreme over ``half`` cells on either side along an axis, at a cost that doesn't grow with ``half``: prefixes and suffixes of blocks meet."""
    if not half:
        return a
    op, far = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
    a = np.moveaxis(a, axis, -1)
    k, n = 2 * half + 1, a.shape[-1]
    blocks = -(-(n + 2 * half) // k)
    padded = np.full((*a.shape[:-1], blocks * k), far)
    padded[..., half : half + n] = a
    cut = padded.reshape(*a.shape[:-1], blocks, k)
    ahead = op.accumulate(cut, -1).reshape(padded.shape)
    back = op.accumulate(cut[..., ::-1], -1)[..., ::-1].reshape(padded.shape)
    return np.moveaxis(op(back[..., :n], ahead[..., k - 1 : k - 1 + n]), -1, axis)


def disc_extreme(a: np.ndarray, radius: int, largest: bool) -> np.ndarray:
    """Extreme over a disc: rows of the disc are running extremes of their widths."""
    out = np.full(a.shape, -np.inf if largest else np.inf)
    op, n = (np.maximum if largest else np.minimum), len(a)
    wide: dict[int, np.ndarray] = {}
    for d in range(-radius, radius + 1):
        half = round(math.sqrt(radius * radius - d * d))
        if half not in wide:
            wide[half] = running_extreme(a, half, 1, largest)
        low, high = max(0, -d), min(n, n - d)
        out[low:high] = op(out[low:high], wide[half][low + d : high + d])
    return out


def _passes(radius: int, order: tuple[bool, bool]) -> Callable:
    """Two extremes after each other; cells outside the raster count for neither."""

    def work(a: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
        for largest in order:
            a = disc_extreme(np.where(inside, a, -np.inf if largest else np.inf), radius, largest)
        return {"v": a}

    return work


def morph_open(df: DataFrame, by: list[str], radius: int, tile: int = TILE) -> DataFrame:
    """Least, then largest value over a disc: bright spots smaller than the disc go."""
    return filter_tiles(df, by, 2 * radius, _passes(radius, (False, True)), "v double", tile=tile)


def morph_close(df: DataFrame, by: list[str], radius: int, tile: int = TILE) -> DataFrame:
    """Largest, then least value over a disc: dark gaps smaller than the disc go."""
    return filter_tiles(df, by, 2 * radius, _passes(radius, (True, False)), "v double", tile=tile)


def morph_clean(df: DataFrame, by: list[str], open_radius: int = 2, close_radius: int = 2, tile: int = TILE) -> DataFrame:
    """Opening, then closing; a radius of 0 leaves that step out."""
    out = morph_open(df, by, open_radius, tile) if open_radius > 0 else df.select(*by, "r", "c", "v")
    return morph_close(out, by, close_radius, tile) if close_radius > 0 else out


def weights(block: int, kind: str) -> np.ndarray:
    """Weights of a window: equal, or a bell whose spread follows from the window."""
    if kind == "mean":
        return np.full(block, 1.0 / block)
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(block) - (block - 1) / 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def smooth(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Both axes weighted one after the other; the rim isn't valid."""
    for axis in (0, 1):
        out, half = np.zeros_like(a), len(w) // 2
        for k, x in enumerate(w):
            out += x * np.roll(a, half - k, axis)
        a = out
    return a


def adaptive_threshold(df: DataFrame, by: list[str], block: int = 51, c: float = 5.0, kind: str = "gaussian", tile: int = TILE) -> DataFrame:
    """(by, r, c, v): 1 where a cell exceeds the weighted mean of its ``block`` by ``block`` window less ``c``; the edge repeats outward.

    An even ``block`` counts as the next odd one.
    """
    block |= 1
    w = weights(block, kind)
    return filter_tiles(df, by, block // 2, lambda a, inside: {"v": (a > smooth(a, w) - c).astype(np.int32)}, "v int", border="replicate", tile=tile)


def otsu(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, c, v): 1 above Otsu's threshold of each raster."""
    from structlab.operators.grid import otsu_threshold

    found = otsu_threshold(df, by)
    joined = df.join(F.broadcast(found), by) if by else df.crossJoin(F.broadcast(found))  # a row per raster
    return joined.select(*by, "r", "c", (F.col("v") > F.col("threshold")).cast("int").alias("v"))


def minority(df: DataFrame, by: list[str]) -> DataFrame:
    """A mask, turned round where more than half of its cells are set."""
    share = df.groupBy(*by).agg((F.avg("v") > 0.5).alias("__turn"))
    joined = df.join(F.broadcast(share), by) if by else df.crossJoin(F.broadcast(share))  # a row per raster
    return joined.select(*by, "r", "c", F.when(F.col("__turn"), 1 - F.col("v")).otherwise(F.col("v")).cast("int").alias("v"))


def sobel(df: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """(by, r, c, gx, gy): 3 by 3 gradients; the raster is mirrored at its edges."""

    def work(a: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
        shifted = lambda dr, dc: np.roll(np.roll(a, -dr, 0), -dc, 1)
        gx = sum(k * (shifted(d, 1) - shifted(d, -1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(k * (shifted(1, d) - shifted(-1, d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
        return {"gx": gx, "gy": gy}

    return filter_tiles(df, by, 1, work, "gx double, gy double", border="reflect", tile=tile)


def swirl(df: DataFrame, by: list[str], rings: int = 4, quantile: float = 0.6, tile: int = TILE) -> DataFrame:
    """(by, ring, n, mean_tangential, sense): the weighted mean of gradients along circles about the centre, per ring, over the strongest gradients.

    A ring without such cells is missing.
    """
    size = extents(df, by)
    g = sobel(df, by, tile)
    g = g.join(F.broadcast(size), by) if by else g.crossJoin(F.broadcast(size))  # a row per raster
    dx, dy = F.col("c") - F.col("w") / 2.0, F.col("r") - F.col("h") / 2.0
    g = g.select(*by, "gx", "gy", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("radius"), (F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) + 1e-6).alias("mag"))
    top = g.groupBy(*by).agg(F.percentile("mag", F.lit(quantile)).alias("least"), F.max("radius").alias("reach"))
    g = g.join(F.broadcast(top), by) if by else g.crossJoin(F.broadcast(top))  # a row per raster
    along = (F.col("gy") * F.col("dx") - F.col("gx") * F.col("dy")) / (F.col("radius") + 1e-6)
    ring = F.floor(F.col("radius") / (F.col("reach") + 1e-6) * rings).cast("int")
    strong = g.filter(F.col("mag") > F.col("least")).select(*by, ring.alias("ring"), along.alias("along"), "mag")
    mean = F.sum(F.col("along") * F.col("mag")) / F.sum("mag")
    out = strong.groupBy(*by, "ring").agg(F.count("*").alias("n"), mean.alias("mean_tangential"))
    return out.withColumn("sense", F.when(F.col("mean_tangential") > 0, "ccw").otherwise("cw"))


def swirl_vote(rings: DataFrame, by: list[str]) -> DataFrame:
    """The sense that most rings have; cw where they tie."""
    votes = F.count_if(F.col("sense") == "ccw")
    return rings.groupBy(*by).agg(F.count("*").alias("n_rings"), votes.alias("n_ccw"), F.when(2 * votes > F.count("*"), "ccw").otherwise("cw").alias("sense"))


def label_runs(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For cells sorted by row and column: the place of the first cell of each one's 8-connected component."""
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(r)) - 1
    parent = list(range(len(first)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    row, low, high = r[first].tolist(), c[first].tolist(), c[last].tolist()
    above = 0
    for k in range(len(row)):
        while above < k and (row[above] < row[k] - 1 or row[above] == row[k] - 1 and high[above] < low[k] - 1):
            above += 1
        at = above
        while at < k and row[at] == row[k] - 1 and low[at] <= high[k] + 1:
            a, b = root(at), root(k)
            parent[max(a, b)] = min(a, b)
            at += 1
    found = np.array([root(k) for k in range(len(row))], int)
    return first[found][np.cumsum(new) - 1]


def components8(df: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """(by, r, c, label) of every set cell (v <> 0): the label names the first cell, by row and column, of some part of its 8-connected component.

    Runs are united inside a tile; labels that touch across tile borders are
    united by ``connected_components``, which sees labels only.
    """
    cells = df.filter("v <> 0").select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    cells = cells.withColumn("tr", F.floor(F.col("r") / tile)).withColumn("tc", F.floor(F.col("c") / tile))
    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "r long, c long, label long"])

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("r", "ascending"), ("c", "ascending")])
        r, c = rows["r"].to_numpy(), rows["c"].to_numpy()
        first = label_runs(r, c)
        return rows.drop_columns(["tr", "tc"]).append_column("label", pa.array((r[first] << 32) + c[first]))

    local = settled(cells.groupBy(*by, "tr", "tc").applyInArrow(one, kinds))
    edge = local.filter(f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    other = lambda x, d: F.floor((F.col(x) + F.col(f"s.{d}")) / tile) != F.floor(F.col(x) / tile)
    over = edge.select("*", steps.alias("s")).filter(other("r", "dr") | other("c", "dc"))
    over = over.select(*by, (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), F.col("label").alias("near"))
    name = lambda x: F.struct(*by, F.col(x).alias("label"))
    touching = over.join(edge, [*by, "r", "c"]).select(name("near").alias("x"), name("label").alias("y")).distinct()
    united = connected_components(touching).select("node.*", F.col("component.label").alias("to"))
    joined = local.join(united, [*by, "label"], "left")
    return joined.select(*by, "r", "c", F.coalesce("to", "label").alias("label"))


def component_shapes(labels: DataFrame, by: list[str]) -> DataFrame:
    """Per component: cells, height, width and elongation (the longer side over the root of the cells)."""
    out = labels.groupBy(*by, "label").agg(F.count("*").alias("area"), (F.max("r") - F.min("r") + 1).alias("height"), (F.max("c") - F.min("c") + 1).alias("width"))
    return out.withColumn("elongation", F.greatest("height", "width") / F.sqrt(F.col("area").cast("double")))


def elongation_score(shapes: DataFrame, by: list[str], min_area: int = 10) -> DataFrame:
    """The most elongated component of at least ``min_area`` cells; 0 where there is none."""
    best = F.max(F.when(F.col("area") >= min_area, F.col("elongation")))
    return shapes.groupBy(*by).agg(F.count("*").alias("n_components"), F.max("area").alias("largest"), F.coalesce(best, F.lit(0.0)).alias("score"))


def geoglyph_score(elongation: Column, peakiness: Column, periodicity: Column) -> Column:
    """Fixed weights of the three signs of drawn structure."""
    return 5.0 * elongation + 0.1 * peakiness + 2.0 * F.greatest(F.lit(0.0), periodicity)


def summed_area(df: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """(by, r, c, s): the sum over all cells up to row r and column c, for every cell of each raster.

    A tile sums its own cells; what lies left, above and above left of it comes
    from running sums over tiles, of one number per row, column or tile.
    """

    def local(rows: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
        return {"own": np.where(inside, rows, 0.0).cumsum(0).cumsum(1)}

    own = settled(filter_tiles(df, by, 0, local, "own double", tile=tile).withColumn("tr", F.floor(F.col("r") / tile)).withColumn("tc", F.floor(F.col("c") / tile)))
    right = own.groupBy(*by, "r", "tr", "tc").agg(F.max_by("own", "c").alias("e"))  # the tile's last column: its rows so far
    below = own.groupBy(*by, "c", "tr", "tc").agg(F.max_by("own", "r").alias("e"))
    whole = right.groupBy(*by, "tr", "tc").agg(F.max_by("e", "r").alias("e"))
    before = lambda keys, order: F.coalesce(F.sum("e").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = right.select(*by, "r", "tc", before([*by, "r"], "tc").alias("left"))
    above = below.select(*by, "c", "tr", before([*by, "c"], "tr").alias("above"))
    corner = whole.select(*by, "tr", "tc", before([*by, "tr"], "tc").alias("e"))  # tiles to the left in the same row of tiles
    corner = corner.select(*by, "tr", "tc", before([*by, "tc"], "tr").alias("corner"))
    out = own.join(left, [*by, "r", "tc"]).join(above, [*by, "c", "tr"]).join(corner, [*by, "tr", "tc"])
    return out.select(*by, "r", "c", (F.col("own") + F.col("left") + F.col("above") + F.col("corner")).alias("s"))


def window_means(points: DataFrame, sums: DataFrame, size: DataFrame, by: list[str], half: int = 1) -> DataFrame:
    """``points`` (by, r, c, ...) with ``mean`` over the cells within ``half`` of each, cut at the raster's edges; null for points outside.

    Each mean is four looked-up sums.
    """
    sized = points.join(F.broadcast(size), by, "left") if by else points.crossJoin(F.broadcast(size))  # a row per raster
    within = (F.col("r") >= 0) & (F.col("r") < F.col("h")) & (F.col("c") >= 0) & (F.col("c") < F.col("w"))
    spots = sized.filter(within).select(*by, "r", "c", "h", "w").distinct()
    r0, r1 = F.greatest(F.col("r") - half, F.lit(0)) - 1, F.least(F.col("r") + half, F.col("h") - 1)
    c0, c1 = F.greatest(F.col("c") - half, F.lit(0)) - 1, F.least(F.col("c") + half, F.col("w") - 1)
    corners = F.explode(F.array(*[F.struct(a.alias("lr"), b.alias("lc"), F.lit(k).alias("sign")) for a, b, k in ((r1, c1, 1), (r0, c1, -1), (r1, c0, -1), (r0, c0, 1))]))
    area = (r1 - r0) * (c1 - c0)
    looked = spots.select(*by, "r", "c", area.alias("area"), corners.alias("k")).select(*by, "r", "c", "area", "k.*")
    looked = looked.join(sums.select(*by, F.col("r").alias("lr"), F.col("c").alias("lc"), "s"), [*by, "lr", "lc"], "left")
    means = looked.groupBy(*by, "r", "c", "area").agg((F.sum(F.col("sign") * F.coalesce("s", F.lit(0.0)))).alias("total"))
    return points.join(means.select(*by, "r", "c", (F.col("total") / F.col("area")).alias("mean")), [*by, "r", "c"], "left")
