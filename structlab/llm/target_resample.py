"""Resampling documents towards a target distribution by importance weights over hashed word features.

Arrow's UTF-8 buffers are classified byte by byte through a lookup table, words
are the differences of that class, and one table-driven CRC register per start
advances by a byte of every feature at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlab.llm import textnum
from structlab.llm.common import Scratch
from structlab.llm.hilbert_shard import ranked

#: Buckets of features, longest feature in words, least words of a document that may be drawn, percentage drawn.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT = 10_000, 1, 20, 10
#: Registers below which an array step costs more than finishing each by a running CRC.
FEW = 16
#: Class of a byte after lower-casing A-Z: letter, digit or part of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def crc_table() -> np.ndarray:
    """The register's step for each low byte (reflected polynomial of CRC-32)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = crc_table()


def word_edges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word: where the class changes, or a row begins or ends inside a word."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _WORD[raw]
    step = np.diff(inside)
    start, end = step == 1, step == -1
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    broken = edge[(inside[edge] == 1) & (inside[edge + 1] == 1)]
    start[broken] = end[broken] = True
    start = np.flatnonzero(start)
    return start, np.flatnonzero(end), np.searchsorted(offsets, start, "right") - 1


def advance(register: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes ``start`` to ``start + size`` of each, all registers a byte further per step."""
    order = np.argsort(-size, kind="stable")
    at, left, state = start[order], size[order], register[order]
    longer = len(order) - np.searchsorted(left[::-1], np.arange(int(left[0]) + 1 if len(left) else 1), "right")
    step = 0
    while step < len(longer) and longer[step] > FEW:
        n = longer[step]
        low = (state[:n] ^ raw[at[:n] + step]) & np.uint32(0xFF)
        state[:n] = _TABLE[low] ^ (state[:n] >> np.uint32(8))
        step += 1
    for k in range(longer[step] if step < len(longer) else 0):
        state[k] = zlib.crc32(raw[at[k] + step : at[k] + left[k]].tobytes(), int(~state[k])) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(raw: np.ndarray, offsets: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, CRC-32) of all runs of 1, 2, ... ``longest`` words of a row, joined by one space; one pair of arrays per length."""
    raw = _LOWER[raw]
    start, end, row = word_edges(raw, offsets)
    begun = np.arange(len(start))
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for n in range(longest):
        if n:
            whole = begun + n < len(row)
            whole[whole] = row[begun[whole] + n] == row[begun[whole]]
            begun, state = begun[whole], state[whole]
            state = _TABLE[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = advance(state, raw, start[begun + n], (end - start)[begun + n])
        yield row[begun], state ^ np.uint32(0xFFFFFFFF)


def bucket_counts(df: DataFrame, text_col: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) over all texts; each task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = textnum.utf8(batch.column(0))
            for low, high in textnum.pieces(raw, offsets):
                for _, crc in features(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "count"])

    parts = df.select(F.col(text_col).alias("body")).mapInArrow(count, "bucket long, count long")
    return parts.groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(source: DataFrame, target: DataFrame, source_text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: the log ratio of its shares in target and source, smoothed by one, in thousandths, floored."""
    spark = source.sparkSession
    both = bucket_counts(source, source_text, longest, buckets).select("bucket", F.col("count").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, target_text, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("count").alias("t")))
    every = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = Scratch(spark, "resample").save(both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "sums")
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    share = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return sums.join(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.ln(share)).cast("long").alias("gain"))


def document_weights(df: DataFrame, gains: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """row_id, n_words, n_features, weight (floored mean of the features' gains, 0 without features) of each row.

    ``gains`` holds one number per bucket, a bound that the caller sets; it
    travels to the tasks as one array.
    """
    rows = gains.orderBy("bucket").toArrow()
    gain = rows["gain"].to_numpy()
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textnum.utf8(batch.column(1))
            for low, high in textnum.pieces(raw, offsets):
                at, n = offsets[low : high + 1] - offsets[low], high - low
                count, total, words = np.zeros(n, np.int64), np.zeros(n, np.int64), None
                for row, crc in features(raw[offsets[low] : offsets[high]], at, longest):
                    here = np.bincount(row, minlength=n)
                    words = here if words is None else words
                    count += here
                    total += np.bincount(row, gain[crc % np.uint32(len(gain))], minlength=n).astype(np.int64)
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), *(pa.array(x, pa.int64()) for x in (words, count, weight))], names=["row_id", "n_words", "n_features", "weight"]
                )

    body = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    return body.mapInArrow(weigh, f"row_id {id_type}, n_words long, n_features long, weight long")


def noise(row_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of SHA-256 of seed and id (no id: ``null``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    seed: int = 2024, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """row_id, n_words, n_features, weight, score, rank (null where not drawn) of every row of ``df``.

    The ``percent`` of the rows with ``least_words`` words that have the highest
    scores are drawn without replacement: weight plus Gumbel noise.  Ranks come
    from one range partitioning of narrow rows, ties going to the smaller id.

    Null and empty texts have no feature and weight 0; a long text is a piece of
    its own.  Rows that share an id share its noise and rank side by side.  An
    empty target leaves the source's own frequencies as (negative) gains; an
    empty ``df`` gives an empty result.
    """
    work = Scratch(df.sparkSession, "resample")
    gains = bucket_gains(df, target, text_col, target_text, longest, buckets)
    scored = document_weights(df, gains, id_col, text_col, longest).withColumn("score", F.col("weight") + noise(F.col("row_id"), seed))
    scored = work.save(scored, "scored")
    able = scored.filter(F.col("n_words") >= least_words).withColumn("low", -F.col("score"))
    placed = ranked(work, able, ["low", "row_id"], "ordered")
    drawn = F.col("rank") < F.expr(f"total * {percent} div 100")
    columns = ["row_id", "n_words", "n_features", "weight", "score"]
    placed = placed.select(*columns, F.when(drawn, F.col("rank") + 1).cast("long").alias("rank"))
    return placed.unionByName(scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
