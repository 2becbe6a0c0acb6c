"""Best-fit-decreasing packing of documents into fixed-length token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlab.llm import textnum
from structlab.llm.common import Scratch
from structlab.llm.unit_encoder import encoder, spans

LENGTH = 2048
#: Pieces that one task packs, in expectation; a group wastes at most part of its last sequences.
GROUP_PIECES = 16384
#: Bytes of text that are encoded at a time (a longer text is one piece).
ENCODED_BYTES = 1 << 21


def cut_pieces(df: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: row_id, piece, start, length, ids_crc32.

    A document's ids end with ``end_id``; a null text has that id only.  Only
    documents longer than ``length`` are cut.  Ids don't leave the task.
    """
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            raw, offsets = textnum.utf8(batch.column(1))
            for low, high in textnum.pieces(raw, offsets, ENCODED_BYTES):
                ids, at = encode(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                ids, at = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4"), at + np.arange(len(at))
                count = -(-np.diff(at) // length)
                row, piece = np.repeat(np.arange(high - low), count), spans(count)
                start = piece * length
                first = at[row] + start
                size = np.minimum(at[row + 1] - first, length)
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + low)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                    names=["row_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(pieces, f"row_id {id_type}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open bins by remaining capacity under a segment tree of counts.

    ``tightest(n)`` finds the least capacity of at least ``n`` that some bin
    has, in time logarithmic in the capacity.
    """

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, bin_id: int) -> None:
        self.bins[left].append(bin_id)
        self._change(left, 1)

    def take(self, left: int) -> int:
        self._change(left, -1)
        return self.bins[left].pop()

    def _change(self, left: int, by: int) -> None:
        node = self.leaves + left
        while node:
            self.count[node] += by
            node //= 2

    def tightest(self, n: int) -> int | None:
        node, count = self.leaves + n, self.count
        if count[node]:
            return n
        while node > 1:
            if not node & 1 and count[node + 1]:  # a left child: the right sibling holds the next larger capacities
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) of each item; items come longest first, and each goes to the tightest bin that holds it."""
    bins, used, out = OpenBins(capacity), 0, []
    for n in lengths:
        left = bins.tightest(n)
        if left is None:
            left, bin_id, used = capacity, used, used + 1
        else:
            bin_id = bins.take(left)
        out.append((bin_id, capacity - left))
        if left > n:
            bins.add(left - n, bin_id)
    return out


def pack_pieces(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Pieces are dealt by a hash into groups of about ``group_pieces``, so the
    number of groups follows the input and none grows with it; one group packs
    as well as the whole but for its last sequences.  Small inputs are one group.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("row_id", "piece", "ids_crc32", "length"), F.lit(groups)).cast("long"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("row_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit(rows["length"].to_pylist(), length)
        group = rows["__group"][0].as_py()
        rows = rows.append_column("sequence_id", pa.array([(group << 32) + b for b, _ in placed], pa.int64()))
        return rows.append_column("offset", pa.array([o for _, o in placed], pa.int64())).drop_columns("__group")

    return dealt.groupBy("__group").applyInArrow(pack, f"{kind}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per piece: row_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed as often as they occur.  An empty table gives an
    empty result.
    """
    work = Scratch(df.sparkSession, "best-fit")
    return pack_pieces(work.save(cut_pieces(df, tokenizer_path, length, id_col, text_col), "pieces"), length)
