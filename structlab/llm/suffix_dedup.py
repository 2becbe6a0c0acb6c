"""Removal of repeated byte strings across all documents with suffix arrays.

A byte goes if a string of ``LEAST`` bytes that covers it also starts earlier:
in a document with a smaller id, or earlier in the same one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlab.llm import textnum
from structlab.llm.common import Scratch, bounded, id_and_text, id_of, repeated_ids
from structlab.llm.suffix_array import permuted_common_prefixes, suffix_order

LEAST = 100
#: Bytes of an anchor; a power of two.  Every string of LEAST bytes holds an anchor that its other copies hold too.
ANCHOR = 32
REACH = LEAST - ANCHOR
#: Strings around an anchor by their bytes to the left of it: from each of these to STEP more.
STEP = 17
STEPS = (0, 17, 34, 51)
#: Surroundings that one shard sorts, in expectation, and the most of one anchor that go to a shard.
SHARD_TEXTS, ANCHOR_TEXTS = 1500, 5000
ID_BOUND = 1_000_000
_WEIGHTS = textnum.keys(8, 0xABCD)


def _doubled(raw: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each position (positions near the end of ``raw`` hold rubbish)."""
    h = textnum.mix(raw.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = 1
    with np.errstate(over="ignore"):
        for k in range(ANCHOR.bit_length() - 1):
            moved = np.zeros_like(h)
            moved[:-step] = h[step:]
            h = h * _WEIGHTS[k] + moved
            step *= 2
    return textnum.mix(h)


def _slid(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of x[i], ..., x[i + width - 1] for each i; the end is padded by x itself."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, position, bytes to the left, bytes to the right, anchor hash, hash of the surroundings): winnowing.

    A position is an anchor if its hash is least in some string of LEAST bytes
    that lies within its row.  Its surroundings are those strings and no
    others, so nearly every string is in the surroundings of one anchor only
    (of several where hashes tie), and of the same one wherever it occurs.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < LEAST:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = _doubled(raw)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][row]
    at = np.arange(len(raw))
    whole = at + LEAST <= end
    least = np.where(whole, _slid(h, REACH + 1, np.minimum), np.uint64(0))
    # The largest least over the strings from i - REACH to i; reversed, so that it slides to the left.
    top = _slid(least[::-1].copy(), REACH + 1, np.maximum)[::-1]
    pos = np.flatnonzero((top == h) & (at + ANCHOR <= end) & (top > 0))
    row = row[pos]
    # The strings in which the anchor is least start at most REACH before it: the first and last of those starts.
    ahead = np.full(len(pos), -1, np.int64)
    behind = np.full(len(pos), -1, np.int64)
    for back in range(REACH, -1, -1):
        start = pos - back
        mine = (start >= offsets[:-1][row]) & (least[np.maximum(start, 0)] == h[pos])
        ahead[mine & (ahead < 0)] = back
        behind[mine] = back
    first, last = pos - ahead, pos - behind + LEAST
    with np.errstate(over="ignore"):
        around = (pos - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - pos).astype(np.uint64)
        for k in range(6):
            around = textnum.mix(around * _WEIGHTS[k] + h[np.minimum(first + 32 * k, last - ANCHOR)])
    return row, pos - offsets[:-1][row], pos - first, last - pos, h[pos], around


def anchor_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, pos, left, right, anchor, around) for every anchor of every text."""
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textnum.utf8(batch.column(1))
            for low, high in textnum.pieces(raw, offsets):
                row, pos, left, right, anchor, around = anchors(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + low)), pa.array(pos), *(pa.array(x.astype(np.int16)) for x in (left, right)), *(pa.array(x.view(np.int64)) for x in (anchor, around))],
                    names=["row_id", "pos", "left", "right", "anchor", "around"],
                )

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(scan, f"row_id {id_type}, pos long, left short, right short, anchor long, around long")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs (touching ones are one run)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.concatenate((at[1:] - 1, [len(ends) - 1]))] if len(at) else ends


def flat_spots(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each struct in a column of lists, and its fields as arrays."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return row, {flat.type.field(k).name: flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)}


def repeated_starts(raw: np.ndarray, sizes: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the LEAST-byte strings of the texts that occur at an earlier (row, start) in any of them.

    ``raw`` is the texts' bytes one after another; ``rows`` and ``starts``
    (below 2^32) say where each text lies.  One suffix array over all texts, a
    separator after each; suffixes that share LEAST symbols are neighbours.
    """
    symbols = np.insert(raw.astype(np.uint16) + 1, np.cumsum(sizes), 0)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.arange(len(symbols)) - np.repeat(np.concatenate(([0], np.cumsum(sizes + 1)[:-1])), sizes + 1)
    order = suffix_order(symbols, 257)
    common = permuted_common_prefixes(symbols, order, LEAST)
    group = np.cumsum(common[order] < LEAST)
    whole = at[order] + LEAST <= sizes[owner[order]]
    order, group = order[whole], group[whole]
    if not len(order):
        return rows[:0], starts[:0]
    place = (rows[owner[order]] << np.int64(32)) + starts[owner[order]] + at[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(place, first), np.diff(np.concatenate((first, [len(place)]))))
    later = np.unique(place[place != least])
    return later >> np.int64(32), later & np.int64((1 << 32) - 1)


def hashed(df: DataFrame) -> DataFrame:
    """``df`` (one row per key) as the side of a shuffled join that hash tables are built of, at every size of it.

    The other side is read as a stream, and adaptive execution splits its hot keys.
    """
    return df.hint("shuffle_hash")


class SuffixDedup:
    """Byte ranges to remove from every document.

    1. Winnowing picks anchors so that equal strings of LEAST bytes hold equal
       anchors at equal places; each carries a hash of its surroundings, which
       hold all such strings around it.  Anchors found once are done with.
    2. Where anchor and surroundings both repeat, everything in them starts
       earlier at their first occurrence: the later ones are removed whole.
    3. First occurrences of different surroundings of one anchor may still
       share strings.  Those that do share the inner part of one of STEPS
       ranges of strings; a hash of each part tells which may be left out.
    4. What is left meets in shards by anchor; a shard's suffix array is
       induced, common prefixes are computed in text order, and neighbours
       that share LEAST bytes are one string.
    5. An anchor with more than ``anchor_texts`` different surroundings (a
       passage that very many documents share) doesn't go to a shard: its
       strings are compared by hash in an aggregate that combines before the
       shuffle.  Nothing is dropped.

    Anchors and surroundings are compared by 64-bit hashes each, strings in
    shards by their bytes.  Joins of anchors, and of texts with their spots,
    are shuffled at every size; only copies and final runs are broadcast, behind
    a check of their count.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor_texts: int = ANCHOR_TEXTS, shard_texts: int = SHARD_TEXTS):
        self.df = df.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
        self.known = self.df.filter("row_id is not null")
        self.id_type = self.df.schema["row_id"].dataType.simpleString()
        self.anchor_texts, self.shard_texts = anchor_texts, shard_texts
        self.work = Scratch(df.sparkSession, "suffix-dedup")

    def copies(self) -> DataFrame:
        """(row_id, keep) of documents whose whole text an earlier document has."""
        digests = self.known.filter(F.octet_length("body") >= LEAST).select("row_id", F.sha2("body", 256).alias("digest"))
        digests = self.work.save(digests, "digests")
        firsts = self.work.save(digests.groupBy("digest").agg(F.min("row_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
        later = digests.join(bounded(firsts, ID_BOUND // 4), "digest").filter("row_id > first").select("row_id").distinct()
        return self.work.save(later, "copies")

    def intervals(self) -> DataFrame:
        """(row_id, low, high) byte ranges to remove; they may overlap.  Whole copies are not among them."""
        work = self.work
        self.whole = self.copies()
        n_whole = self.whole.count()
        rows = self.known if n_whole > ID_BOUND else self.known.join(F.broadcast(self.whole), "row_id", "left_anti")
        self.fresh = rows
        found = work.save(anchor_rows(rows, "row_id", "body"), "anchors")
        counts = work.save(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "counts")
        found = work.save(found.join(hashed(counts), "anchor", "left_semi"), "shared")
        work.drop("anchors", "counts")
        pairs = found.groupBy("anchor", "around").agg(F.min(F.struct("row_id", "pos", "left", "right")).alias("first"), F.count("*").alias("n"))
        pairs = work.save(pairs, "pairs")
        repeated = pairs.filter("n > 1").select("anchor", "around", "first")
        later = found.join(hashed(repeated), ["anchor", "around"]).filter(F.struct("row_id", "pos", "left", "right") != F.col("first"))
        same = later.select("row_id", (F.col("pos") - F.col("left")).alias("low"), (F.col("pos") + F.col("right")).alias("high"))
        spread = work.save(pairs.groupBy("anchor").agg(F.count("*").alias("texts")).filter("texts > 1"), "spread")
        open_rows = pairs.join(hashed(spread), "anchor").select("anchor", "texts", "first.*")
        open_rows = work.save(open_rows, "open")
        near = self.near_spots(rows, open_rows)
        work.drop("spread", "open")
        hot = near.groupBy("anchor").agg((F.count("*") > self.anchor_texts).alias("hot"))
        hot = work.save(hot, "hot_anchors")
        near = work.save(near.join(hashed(hot), "anchor"), "near_hot")
        texts = self.with_spots(rows, near, "pos", "anchor", "left", "right", "hot")
        parts = [same]
        if near.filter("hot").limit(1).count():
            parts.append(self.by_hash(texts))
        parts.append(self.by_suffix_array(texts, near.count()))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0].unionByName(parts[1]).unionByName(parts[2])

    def with_spots(self, rows: DataFrame, spots: DataFrame, *columns: str) -> DataFrame:
        """(row_id, body, spots) of the rows that have spots."""
        lists = spots.groupBy("row_id").agg(F.collect_list(F.struct(*columns)).alias("spots"))
        lists = self.work.save(lists, "lists")
        return rows.join(hashed(lists), "row_id").select("row_id", "body", "spots")

    def near_spots(self, rows: DataFrame, open_rows: DataFrame) -> DataFrame:
        """(row_id, pos, anchor, left, right): open spots that may share a string with another one, cut down to the steps in which."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blake = hashlib.blake2b
            for batch in batches:
                raw, offsets = textnum.utf8(batch.column(1))
                body = raw.tobytes()
                row, spot = flat_spots(batch.column(2))
                pos, anchor, left, right = (spot[x].astype(np.int64) for x in ("pos", "anchor", "left", "right"))
                for g in STEPS:
                    # Strings with g to g + STEP bytes to the left of the anchor, of those that are its own.
                    most, fewest = np.minimum(g + STEP, left), np.maximum(g, LEAST - right)
                    k = np.flatnonzero(fewest <= most)
                    seeds, low = anchor[k].tobytes(), (offsets[row[k]] + pos[k] - g).tolist()
                    salt, size = bytes((g,)), LEAST - STEP
                    key = [blake(body[a : a + size], digest_size=8, key=seeds[8 * i : 8 * i + 8], salt=salt).digest() for i, a in enumerate(low)]
                    columns = [pos[k], anchor[k], most[k].astype(np.int16), (LEAST - fewest[k]).astype(np.int16), np.frombuffer(b"".join(key), np.int64)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row[k])), *(pa.array(x) for x in columns)], names=["row_id", "pos", "anchor", "left", "right", "key"]
                    )

        texts = self.with_spots(rows, open_rows, "pos", "anchor", "left", "right")
        probes = self.work.save(texts.mapInArrow(probe, f"row_id {self.id_type}, pos long, anchor long, left short, right short, key long"), "probes")
        twice = self.work.save(probes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "twice")
        near = probes.join(hashed(twice), "key", "left_semi").groupBy("row_id", "pos", "anchor")
        near = self.work.save(near.agg(F.max("left").alias("left"), F.max("right").alias("right")), "near")
        self.work.drop("probes", "twice", "lists")
        self.work.release()
        return near

    def by_suffix_array(self, texts: DataFrame, n_open: int) -> DataFrame:
        shards = max(1, -(-n_open // self.shard_texts))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = textnum.utf8(batch.column(1))
                body = raw.tobytes()
                row, spot = flat_spots(batch.column(2))
                k = np.flatnonzero(~spot["hot"].astype(bool))
                row, start = row[k], spot["pos"][k] - spot["left"][k]
                low = offsets[row] + start
                high = low + spot["left"][k] + spot["right"][k]
                around = [body[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(spot["anchor"][k]), pa.array(around, pa.binary())],
                    names=["row_id", "start", "anchor", "around"],
                )

        def sort(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            id_column, around = (rows.column(x).chunk(0) for x in ("row_id", "around"))
            ids, number = np.unique(id_column.to_numpy(zero_copy_only=False), return_inverse=True)
            sizes = pc.binary_length(around).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = np.frombuffer(b"".join(around.to_pylist()), np.uint8)
            row, start = repeated_starts(raw, sizes, number.astype(np.int64), rows.column("start").to_numpy().astype(np.int64))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + LEAST)
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(row)]))[: len(first)] - 1
            return pa.table({"row_id": pa.array(ids[row[first]], id_column.type), "low": start[first], "high": start[last] + LEAST})

        spots = texts.select("row_id", "body", "spots").mapInArrow(cut, f"row_id {self.id_type}, start long, anchor long, around binary")
        dealt = spots.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        return dealt.groupBy("shard").applyInArrow(sort, f"row_id {self.id_type}, low long, high long")

    def by_hash(self, texts: DataFrame) -> DataFrame:
        """Strings around hot anchors: a 128-bit hash of each, first places by an aggregate, later ones removed."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, start, key = [], [], []
                for k, (body, spots) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    raw = body.encode()
                    places = {i for s in spots if s["hot"] for i in range(s["pos"] - s["left"], s["pos"] + s["right"] - LEAST + 1)}
                    for i in sorted(places):
                        at.append(k)
                        start.append(i)
                        key.append(hashlib.blake2b(raw[i : i + LEAST], digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(key, pa.binary())], names=["row_id", "start", "key"]
                )

        strings = texts.select("row_id", "body", "spots").mapInArrow(cut, f"row_id {self.id_type}, start long, key binary")
        strings = self.work.save(strings, "hot_strings")
        firsts = strings.groupBy("key").agg(F.min(F.struct("row_id", "start")).alias("first"), F.count("*").alias("n"))
        firsts = self.work.save(firsts.filter("n > 1").select("key", "first"), "hot_firsts")
        later = strings.join(bounded(firsts, ID_BOUND), "key").filter(F.struct("row_id", "start") != F.col("first"))
        return later.select("row_id", F.col("start").alias("low"), (F.col("start") + LEAST).alias("high"))

    def run(self) -> DataFrame:
        """row_id, n_bytes, spans (array of maximal removed [low, high)) and kept_text (binary) per row.

        Null texts are empty; rows without an id lose nothing and take nothing
        from others; rows that repeat an id and text are one document.  An
        empty table gives an empty result.
        """
        work = self.work
        ranges = work.save(self.intervals(), "ranges")
        work.drop(*[name for name in work.paths if name not in ("ranges", "copies")])
        work.release()
        per_row = ranges.groupBy("row_id").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, span = flat_spots(batch.column(1))
                low, high = merged((row << np.int64(40)) + span["low"], (row << np.int64(40)) + span["high"])
                offsets = np.searchsorted(low >> np.int64(40), np.arange(batch.num_rows + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(x & np.int64((1 << 40) - 1)) for x in (low, high)], ["low", "high"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["row_id", "ranges"])

        per_row = work.save(per_row.mapInArrow(unite, f"row_id {self.id_type}, ranges array<struct<low:long,high:long>>"), "ranges_by_row")
        work.drop("ranges")
        work.release()
        n_runs = per_row.agg(F.sum(F.size("ranges"))).first()[0] or 0
        every = self.df.join(bounded(per_row, ID_BOUND // 2, n_runs), "row_id", "left")
        whole = self.whole.select("row_id", F.lit(True).alias("copy"))
        every = every.join(bounded(whole, ID_BOUND), "row_id", "left").select("row_id", "body", "ranges", F.coalesce("copy", F.lit(False)).alias("copy"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, spans, kept = [], [], []
                for body, ranges, copy in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    raw = body.encode()
                    size.append(len(raw))
                    if copy:
                        ranges = [{"low": 0, "high": len(raw)}]
                    if not ranges:
                        spans.append([])
                        kept.append(raw)
                        continue
                    low, high = merged(np.array([max(0, r["low"]) for r in ranges]), np.array([min(len(raw), r["high"]) for r in ranges]))
                    spans.append([{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                    edges = [0, *(x for s in spans[-1] for x in (s["low"], s["high"])), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["row_id", "n_bytes", "spans", "kept_text"]
                )

        return every.mapInArrow(cut, f"row_id {self.id_type}, n_bytes long, spans array<struct<low:long,high:long>>, kept_text binary")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SuffixDedup.run``; where ids repeat, documents are told apart (and ordered) by id and digest of the text."""
    if repeated_ids(df, id_col).isEmpty():
        return SuffixDedup(df, id_col, text_col).run()
    keyed = df.select(id_and_text(df, id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    return SuffixDedup(keyed, "__key", "__text").run().withColumn("row_id", id_of("row_id", df.schema[id_col].dataType))
