"""Hard negatives by a vector-approximation file.

Each dimension is quantised into 16 cells; two dimensions share a byte.  For an
anchor a table gives the least and the greatest product of each byte, so bounds
of a score are sums of looked-up numbers, and only rows whose bounds may enter
a window are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structlab.llm.common import Scratch

CELLS = 16
#: Rows that the cells' edges are fitted on (those with the smallest hashes of their ids); the outer edges hold all rows.
FITTED = 4096
#: Anchors that one pass over the file serves, in expectation.
BLOCK = 4096


def clean_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vec (floor of ``scale`` times each component) of the rows that take part.

    Rows without an id, label or vector, and rows with a null or non-finite component, don't.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("raw"))
    odd = F.exists("raw", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull()).filter(~odd)
    return rows.select("vec_id", "label", F.transform("raw", lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as integers; a shorter row ends in zeros."""
    size = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if len(size) and (size == dims).all():
        return values.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def extremes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each dimension over all rows; a task sends one row."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = None, None
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0), dims)
                low = m.min(0) if low is None else np.minimum(low, m.min(0))
                high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(low), pa.array(high)], names=["dim", "low", "high"])

    found = vectors.select("vec").mapInArrow(ends, "dim long, low long, high long").groupBy("dim").agg(F.min("low"), F.max("high")).orderBy("dim").collect()
    return np.array([r[1] for r in found], np.int64), np.array([r[2] for r in found], np.int64)


def fit_cells(vectors: DataFrame, dims: int, fitted: int = FITTED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner cuts, least, greatest value) of the cells of each dimension.

    Cuts are quantiles of at most ``fitted`` rows; the outer cells reach the
    extremes of all rows, so the bounds hold for every row.
    """
    low, high = extremes(vectors, dims)
    if dims * max(-int(low.min()), int(high.max())) ** 2 >= 1 << 62:
        raise ArithmeticError("scores of such components don't fit a long")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fitted).select("vec").toArrow()["vec"].combine_chunks()
    cuts = np.quantile(matrix(sample, dims), np.arange(1, CELLS) / CELLS, axis=0, method="higher").T.astype(np.int64)
    least = np.concatenate((low[:, None], np.maximum(cuts, low[:, None])), axis=1)
    greatest = np.concatenate((np.minimum(cuts - 1, high[:, None]), high[:, None]), axis=1)
    return cuts, least, np.maximum(greatest, least)


def approximate(vectors: DataFrame, cuts: np.ndarray, parts: int) -> DataFrame:
    """``vectors`` with ``code``: a byte per two dimensions, each half of which names a cell."""
    dims = len(cuts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("vec"), dims)
            cell = np.zeros((len(m), dims + dims % 2), np.uint8)
            for d in range(dims):
                cell[:, d] = np.searchsorted(cuts[d], m[:, d], "right")
            both = np.ascontiguousarray(cell[:, ::2] * CELLS + cell[:, 1::2])
            binary = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * both.shape[1]).astype(np.int32)), pa.py_buffer(both)])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dims, pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), binary, values], names=["vec_id", "label", "code", "vec"])

    return vectors.repartition(parts).mapInArrow(code, "vec_id long, label long, code binary, vec array<long>")


def score_tables(anchor: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """(bytes, 256, 2): the least and the greatest part of a score that each byte of a code stands for."""
    a, b = anchor[:, None] * least, anchor[:, None] * greatest
    one = np.stack((np.minimum(a, b), np.maximum(a, b)), axis=2)
    if len(one) % 2:
        one = np.concatenate((one, np.zeros((1, CELLS, 2), one.dtype)))
    return (one[::2, :, None, :] + one[1::2, None, :, :]).reshape(-1, CELLS * CELLS, 2)


def score_bounds(tables: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of rows whose code bytes are the columns of ``codes``."""
    total = tables[0].take(codes[0], axis=0)
    part = np.empty_like(total)
    for table, byte in zip(tables[1:], codes[1:], strict=True):
        total += table.take(byte, axis=0, out=part, mode="clip")
    return total[:, 0], total[:, 1]


def first_scores(score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((vec_id[some], -score[some]))[:k]]
    return np.lexsort((vec_id, -score))


class Best:
    """The ``k`` best rows of a window so far: (scores, ids)."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.score, self.vec_id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may_enter(self, low: np.ndarray, high: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Which open rows, by the bounds of their scores, may be among the best: those out of the window, or below ``k`` rows sure to be in it, can't."""
        sure = open_ if self.low is None else open_ & (low >= self.low) & (high <= self.high)
        inside = low[sure]
        least = np.partition(inside, len(inside) - self.k)[len(inside) - self.k] if len(inside) >= self.k else None
        if len(self.score) == self.k:
            least = self.score[-1] if least is None else max(least, self.score[-1])
        keep = open_ if self.low is None else open_ & (high >= self.low) & (low <= self.high)
        return keep if least is None else keep & (high >= least)

    def add(self, score: np.ndarray, vec_id: np.ndarray) -> None:
        if self.low is not None:
            inside = (score >= self.low) & (score <= self.high)
            score, vec_id = score[inside], vec_id[inside]
        score, vec_id = np.concatenate((self.score, score)), np.concatenate((self.vec_id, vec_id))
        first = first_scores(score, vec_id, self.k)
        self.score, self.vec_id = score[first], vec_id[first]


def search(file: DataFrame, anchors: pa.Table, windows: list[list[tuple[int, int | None, int | None]]], same_label: bool, k: int, least: np.ndarray, greatest: np.ndarray) -> DataFrame:
    """(anchor, window, score, vec_id): the ``k`` best rows of each window of each anchor in each task, then of all tasks.

    Rows with the anchor's id aren't searched.  ``windows`` holds (number, least, greatest score) per anchor.
    """
    dims = len(least)
    ids, labels, vectors = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["vec"].combine_chunks(), dims)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[Best(k, low, high) for _, low, high in w] for w in windows]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vec_id, label = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            order = np.argsort(label, kind="stable")
            vec_id, label = vec_id[order], label[order]
            vec = matrix(batch.column("vec"), dims)[order]
            code = batch.column("code")
            codes = np.frombuffer(code.buffers()[2], np.uint8)[code.offset * ((dims + 1) // 2) :][: n * ((dims + 1) // 2)]
            codes = np.ascontiguousarray(codes.reshape(n, -1)[order].T)
            for a in range(len(ids)):
                if not best[a]:
                    continue
                first, last = np.searchsorted(label, labels[a]), np.searchsorted(label, labels[a], "right")
                part = slice(first, last) if same_label else slice(0, n)
                open_ = vec_id[part] != ids[a]
                if not same_label:
                    open_[first:last] = False
                if not open_.any():
                    continue
                low, high = score_bounds(score_tables(vectors[a], least, greatest), codes[:, part])
                may = [b.may_enter(low, high, open_) for b in best[a]]
                some = np.flatnonzero(np.logical_or.reduce(may))
                score, here = vec[part][some] @ vectors[a], vec_id[part][some]
                for b, m in zip(best[a], may, strict=True):
                    b.add(score[m[some]], here[m[some]])
        found = [(a, number, b) for a, w in enumerate(windows) for (number, _, _), b in zip(w, best[a], strict=True) if len(b.score)]
        if found:
            size = [len(b.score) for *_, b in found]
            columns = [np.repeat([x[0] for x in found], size), np.repeat([x[1] for x in found], size), np.concatenate([b.score for *_, b in found]), np.concatenate([b.vec_id for *_, b in found])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "window", "score", "vec_id"])

    found = file.mapInArrow(scan, "anchor long, window long, score long, vec_id long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that ``anchors`` (an expression over vec_id, label and
    vec) picks.  An anchor's positives are its ``positives`` best other rows of
    its label; for each, its ``negatives`` best rows of other labels whose
    scores are ``window`` percent of the positive's are returned.  Anchors come
    in blocks of about ``block``; a block and its positives (a number that the
    block bounds) are sent to the tasks, and every row of the file is held
    against them.  What each task returns doesn't grow with its rows.

    Rows without an id, label or vector, or with a null or non-finite component,
    take no part.  Shorter vectors count as ending in zeros.  Rows with the
    anchor's id are never its positives or negatives; repeated rows of another
    id each take a rank, and each repeated row of an anchor is an anchor.  A
    positive below zero has no window.  An empty table, or one without anchors,
    gives an empty result.
    """
    spark = df.sparkSession
    work = Scratch(spark, "vector-file")
    vectors = work.save(clean_vectors(df, scale, id_col, vector_col, label_col), "vectors")
    kept = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n, dims = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    n_anchors = vectors.filter(anchors).count()
    if not n_anchors:
        return spark.createDataFrame([], kept)
    dims = max(dims, 1)
    cuts, least, greatest = fit_cells(vectors, dims)
    file = work.save(approximate(vectors, cuts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n >> 16)), "file")
    blocks, out = -(-n_anchors // block), []
    for b in range(blocks):
        chosen = file.filter(anchors).filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "label", "vec").toArrow()
        if not chosen.num_rows:
            continue
        every = search(file, chosen, [[(0, None, None)]] * chosen.num_rows, True, positives, least, greatest)
        found = work.save(every.select("anchor", "score", "rank", F.col("vec_id").alias("positive_id")), f"positives{b}")
        windows: list[list[tuple[int, int | None, int | None]]] = [[] for _ in range(chosen.num_rows)]
        for r in found.collect():
            low, high = -(-window[0] * r.score // 100), window[1] * r.score // 100
            if low <= high:
                windows[r.anchor].append((r.rank, low, high))
        mined = search(file, chosen, windows, False, negatives, least, greatest)
        mined = mined.select("anchor", F.col("window").alias("place"), F.col("rank").alias("n_rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = spark.createDataFrame(pa.table({"anchor": np.arange(chosen.num_rows), "anchor_id": chosen["vec_id"]}))
        pairs = found.withColumnRenamed("rank", "place").join(F.broadcast(named), "anchor")  # a block of anchors, at most ``positives`` rows each
        pairs = mined.join(F.broadcast(pairs), ["anchor", "place"])
        pairs = pairs.select("anchor_id", "positive_id", F.col("n_rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")
        out.append(work.save(pairs, f"mined{b}"))
    if not out:
        return spark.createDataFrame([], kept)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every
