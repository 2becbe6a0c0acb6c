"""Sharding along a Hilbert curve over metadata (DataFrame functions only).

Several dimensions are quantised to a few bits each, the rows are ordered by
their place on the curve, and runs of that order become shards: a shard then
spans a small range of every dimension, and min/max statistics prune files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structlab.llm.common import Scratch

BITS = 4
#: Most distinct strings of a dimension, and most bytes of them, whose places are broadcast.
VALUE_BOUND, VALUE_BYTES = 100_000, 16 << 20
ROW_BITS = 33  # monotonically_increasing_id holds the partition above these


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType))


def ranked(work: Scratch, df: DataFrame, key: list[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (place in the order of ``key``, from 0) and ``total`` (rows).

    Rows are range-partitioned; a rank is the place within a partition plus the
    partition's offset, so no task sees more than its partition.  The order is
    written once and read again, because a second range partitioning might cut
    elsewhere.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id())
    ordered = work.save(ordered, name)
    ordered = ordered.withColumn("part", F.shiftright("at", ROW_BITS)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(  # one row per partition
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    return ordered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("place")).drop("at", "part", "place", "offset")


def with_places(work: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the whole strings in ``name`` replaced by their places among the distinct ones (null first).

    The distinct strings combine before the shuffle and are ordered like the
    rows; their places are broadcast if few and short enough, else the join is
    shuffled and adaptive execution splits hot strings.
    """
    values = ranked(work, rows.filter(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct(), ["value"], f"values-{name}")
    places = work.save(values.select("value", F.col("rank").cast("double").alias("number")), f"places-{name}")
    n, size = places.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    places = F.broadcast(places) if n <= VALUE_BOUND and size <= VALUE_BYTES else places
    joined = rows.join(places, F.col(name) == F.col("value"), "left")
    return joined.withColumn(name, F.coalesce("number", F.lit(float("-inf")))).drop("value", "number")


def as_number(df: DataFrame, name: str) -> Column:
    """An order-preserving double of a value that isn't a string; null and NaN first."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    else:
        value = F.col(name).cast("double")
        value = F.when(~F.isnan(value), value)
    return F.coalesce(value, F.lit(float("-inf")))


def hilbert_index(codes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of cells given by ``bits``-bit integer codes.

    The axes-to-transpose form: an inverse-undo pass from the high bit down, a
    Gray encoding, then the bits of all axes interleaved.  Loops are folds over
    literal sequences, so the expression stays small.
    """
    d = len(codes)

    def undo(x: Column, q: Column, i: int) -> Column:
        here, first, low = F.get(x, F.lit(i)), F.get(x, F.lit(0)), q - F.lit(1)
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        return F.when(
            here.bitwiseAND(q) != 0,
            F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)),
        ).otherwise(F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)) if i else x)

    axes = F.array(*[c.cast("int") for c in codes])
    if bits > 1:
        steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(d)])

        def step(x: Column, s: Column) -> Column:
            out = x
            for i in range(d):
                out = F.when(s["i"] == i, undo(x, s["q"], i)).otherwise(out) if i else F.when(s["i"] == 0, undo(x, s["q"], 0)).otherwise(x)
            return out

        axes = F.aggregate(steps, axes, step)
    # Gray encode: prefix xor over the axes, then the correction by the last axis.
    empty = F.array().cast("array<int>")
    gray = F.aggregate(
        axes, empty, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0)).bitwiseXOR(v)))
    )
    powers = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    last = lambda x: F.element_at(x, d)
    fix = lambda x: F.aggregate(
        powers, F.lit(0), lambda t, q: F.when(last(x).bitwiseAND(q) != 0, t.bitwiseXOR(q - F.lit(1))).otherwise(t)
    )
    coded = F.transform(F.array(gray), lambda x: F.transform(x, lambda v: v.bitwiseXOR(fix(x))))[0]
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(d)])
    return F.transform(
        F.array(coded),
        lambda x: F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda h, p: F.shiftleft(h, 1).bitwiseOR(
                F.when(F.get(x, p["i"]).bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(bits)]), p["b"] + 1)) != 0, 1).otherwise(0).cast("long")
            ),
        ),
    )[0]


def hilbert_shards(
    df: DataFrame, dims: list[str], n_shards: int = 16, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", whole: bool = False
) -> DataFrame:
    """Law ``rows``: row_id, size, text_crc32, curve, shard, slot; shard sizes differ by one row at most.

    Cut points of each dimension are approximate quantiles over all rows (2^bits
    - 1 per dimension are collected).  Only narrow rows are range-partitioned,
    by (curve, text CRC, id): a cell with a third of all rows is split by the
    rest of the key, and equal texts lie side by side.  Strings count by their
    places among all distinct strings of their dimension.

    Null dimensions come first; a null text is empty (size 1).  An empty table
    gives an empty result.  Repeated rows take neighbouring slots.  With
    ``whole`` each row's own columns come along as a struct ``row``.
    """
    work = Scratch(df.sparkSession, "hilbert")
    body = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.struct("*").alias("row")] if whole else []
    kept = ["row"] if whole else []
    rows = df.select(
        F.col(id_col).alias("row_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        *[(F.col(c) if is_string(df, c) else as_number(df, c)).alias(f"dim{k}") for k, c in enumerate(dims)],
        *carried,
    )
    rows = work.save(rows, "rows")
    for k, c in enumerate(dims):
        if is_string(df, c):
            rows = with_places(work, rows, f"dim{k}")
    shares = [k / 2**bits for k in range(1, 2**bits)]
    cuts = rows.agg(*[F.percentile_approx(f"dim{k}", shares, 10_000).alias(f"dim{k}") for k in range(len(dims))]).first()
    codes = []
    for k in range(len(dims)):
        points = sorted(set(cuts[k] or []))
        codes.append(sum((F.when(F.col(f"dim{k}") > F.lit(p), 1).otherwise(0) for p in points), F.lit(0)))
    cells = rows.select("row_id", "size", "text_crc32", hilbert_index(codes, bits).alias("curve"), *kept)
    placed = ranked(work, cells, ["curve", "text_crc32", "row_id"], "ordered")
    work.drop("rows")
    placed = placed.withColumn("shard", F.expr(f"(rank * {n_shards}) div total"))
    start = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return placed.select("row_id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"), (F.col("rank") - start).alias("slot"), *kept)


def write_shards(df: DataFrame, dims: list[str], path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``df`` as one folder per shard, rows in curve order, so that file statistics prune every dimension.

    Rows travel with their slots, so rows that repeat or have no id are written once each.
    """
    placed = hilbert_shards(df, dims, n_shards, id_col=id_col, text_col=text_col, whole=True)
    placed = placed.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(n, "_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    placed.write.partitionBy("_shard").parquet(path)
