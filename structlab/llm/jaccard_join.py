"""N-gram Jaccard join as a blocked sparse matrix product.

Documents by n-grams form a sparse incidence matrix A.  Linked documents are
the large entries of A times its transpose; the product is taken block by block
over the columns that can matter (each row's rarest n-grams, as many as its
size demands), partial overlaps are summed per pair, and pairs that their sizes
rule out are dropped before the rest of the product is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structlab.llm import textnum
from structlab.llm.common import Scratch, bounded, id_and_text, id_of, repeated_ids
from structlab.llm.components import connected_components

#: Cells of the sketch of n-gram counts, and the slices it is summed in.
CELLS, SLICES = 1 << 20, 64
#: Most ids that are broadcast to pick rows.
ID_BOUND = 1_000_000
#: Ranges of hashes that a row's n-grams are counted in.
RANGES = 32
#: Words of 64 bits that hold, per bit, whether a row has an odd number of n-grams with that hash.
WORDS = 8
#: Prefix n-grams that two linked rows are made to share (fewer in rows too small for that), and the earlier ones of a row
#: by which a block can tell that other blocks have given enough of these already.
SHARED, EARLIER = 4, 6


def _order(row: np.ndarray, value: np.ndarray, load: np.ndarray | None) -> np.ndarray:
    """The order of n-grams within each row: by load class (rare first), then hash."""
    if load is None:
        return np.arange(len(row))
    return np.lexsort((value, load[(value >> np.uint64(11)).astype(np.int64) & (CELLS - 1)], row))


def row_sets(df: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (row_id, size, sig1, sig2) of all documents and rows (slice, counts) of each task's n-gram sketch."""
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        ids = pa.string()
        for batch in batches:
            ids = batch.column(0).type
            raw, offsets = textnum.utf8(batch.column(1))
            size = np.zeros(len(batch), np.int64)
            sig = np.zeros((2, len(batch)), np.uint64)
            for low, high in textnum.pieces(raw, offsets):
                row, value = textnum.shingle_sets(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], n)
                if not len(row):
                    continue
                np.add.at(counts, (value >> np.uint64(11)).astype(np.int64) & (CELLS - 1), 1)
                size[low:high] = np.bincount(row, minlength=high - low)
                at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                with np.errstate(over="ignore"):
                    for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
                        sig[k, low + row[at]] = np.add.reduceat(textnum.mix(value + np.uint64(salt)), at)
            none = pa.nulls(len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), *(pa.array(s.view(np.int64)) for s in sig), none.cast(pa.int32()), none.cast(pa.binary())],
                names=["row_id", "size", "sig1", "sig2", "slice", "counts"],
            )
        if counts.any():
            parts = counts.reshape(SLICES, -1)
            none = pa.nulls(SLICES)
            yield pa.RecordBatch.from_arrays(
                [none.cast(ids), *[none.cast(pa.int64())] * 3, pa.array(range(SLICES), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())],
                names=["row_id", "size", "sig1", "sig2", "slice", "counts"],
            )

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(scan, f"row_id {id_type}, size long, sig1 long, sig2 long, slice int, counts binary")


def load_classes(scanned: DataFrame, rows: int) -> np.ndarray:
    """Class of each sketch cell: 0 for ordinary ones, else the bit length of its excess.

    The sketch counts the n-grams of all documents in a fixed number of cells,
    so its size doesn't grow.  A cell is heavy if it exceeds the mean by a
    thousandth of the rows.  Classes only set an order; results don't depend on them.
    """
    parts = scanned.filter("slice is not null").select("slice", "counts")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own[k] = own.get(k, 0) + np.frombuffer(raw, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([v.tobytes() for v in own.values()], pa.binary())], names=["slice", "counts"])

    summed = parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()
    counts = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for r in summed:
        counts[r["slice"]] += np.frombuffer(bytes(r["counts"]), "<i8")
    counts = counts.reshape(-1)
    excess = counts - counts.mean() - max(8, rows / 1000)
    return np.where(excess > 0, np.frexp(np.maximum(excess, 1))[1], 0).astype(np.int8)


def row_prefixes(df: DataFrame, n: int, percent: int, load: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(row_id, size, grams, ranges, bits): the first size - o + s n-grams of each row, with o = ceil(percent * size / 100) the
    least overlap of a link and s = min(SHARED, o).

    Two linked rows share at least the smaller s of these, whatever the common order is.  ``ranges`` counts all
    n-grams of the row by their hash's range, as bytes above or below size / RANGES (null if one is too large for it):
    an overlap is at most the sum of the smaller counts.  ``bits`` are the parities of how many n-grams fall on each of
    64 * WORDS bits: where two rows differ in one, an n-gram is in one row only.
    """
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(load)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textnum.utf8(batch.column(1))
            for low, high in textnum.pieces(raw, offsets):
                row, value = textnum.shingle_sets(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], n)
                order = _order(row, value, shared.value)
                row, value = row[order], value[order]
                size = np.bincount(row, minlength=high - low)
                first = np.concatenate(([0], np.cumsum(size)[:-1]))
                least = (percent * size + 99) // 100
                most = np.where(size > 0, size - least + np.minimum(SHARED, least), 0)
                head = np.arange(len(row)) - first[row] < most[row]
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(most))), pa.int32()), pa.array(value[head].view(np.int64)))
                part = (value >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)
                table = np.bincount(row * RANGES + part, minlength=(high - low) * RANGES).reshape(high - low, RANGES)
                table -= size[:, None] // RANGES
                fits = np.abs(table).max(1, initial=0) < 1 << 7
                ends = pa.array(np.concatenate(([0], np.cumsum(np.where(fits, RANGES, 0)))), pa.int32())
                ranges = pa.ListArray.from_arrays(ends, pa.array(table[fits].ravel().astype(np.int8)), mask=pa.array(~fits))
                spot = row * (64 * WORDS) + ((value >> np.uint64(32)) & np.uint64(64 * WORDS - 1)).astype(np.int64)
                odd = (np.bincount(spot, minlength=(high - low) * 64 * WORDS) & 1).astype(np.uint8).reshape(high - low, 64 * WORDS)
                words = np.packbits(odd, axis=1, bitorder="little").view("<i8")
                bits = pa.StructArray.from_arrays([pa.array(words[:, k].copy()) for k in range(WORDS)], names=[f"w{k}" for k in range(WORDS)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(size), grams, ranges, bits], names=["row_id", "size", "grams", "ranges", "bits"])

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    words = ", ".join(f"w{k}: long" for k in range(WORDS))
    return rows.mapInArrow(scan, f"row_id {id_type}, size long, grams array<long>, ranges array<byte>, bits struct<{words}>")


def full_sets(df: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(row_id, grams): all n-grams of each row."""
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textnum.utf8(batch.column(1))
            for low, high in textnum.pieces(raw, offsets):
                row, value = textnum.shingle_sets(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], n)
                size = np.bincount(row, minlength=high - low)
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), grams], names=["row_id", "grams"])

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(scan, f"row_id {id_type}, grams array<long>")


def _need(percent: int, a: str, b: str):
    """Least overlap of a linked pair: ceil(percent * (a + b) / (100 + percent))."""
    return F.expr(f"({percent} * ({a} + {b}) + {100 + percent} - 1) div {100 + percent}")


def _sizes_fit(percent: int, a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


class JaccardJoin:
    """Components of documents whose n-gram sets have a Jaccard similarity of ``percent`` / 100 or more.

    1. Every text is read whole; equal sets collapse into classes by size and
       a 128-bit signature.  Only one document of each class goes on.
    2. The product over prefix columns is first taken against one central row
       per block (an n-gram and a band of sizes): as many pairs as entries.
    3. Blocks that still hold several components get the product of all their
       rows across components: no link between components is lost, and a
       block that has become one component costs nothing.  A pair counts in a
       block only where its rows don't show ``SHARED`` common n-grams among
       the ``EARLIER`` ones before it; so pairs that share many columns are
       made a few times, and still reach the count that a link needs.
    4. Pairs are dropped by bounds that their sizes give: sizes too unlike,
       too few n-grams that can follow, too many n-grams that only one row has
       by the parities of hashes, or by the smaller counts per range of
       hashes; pairs with pivots also by the overlap of both prefixes and
       what can follow it.
       The rest get the full product of their two rows.

    ``links`` holds what ``run`` verifies: a subset of the links between
    classes that spans every component.  ``link_counts`` verifies the pairs
    inside components too and counts all links of each document.

    N-grams are compared by 64-bit hashes.  A document without words links
    with nothing.  Repeated rows of one id are one document.
    """

    def __init__(self, df: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text"):
        self.n, self.percent, self.id_col, self.text_col = n, percent, id_col, text_col
        self.df = df.select(id_col, text_col)
        self.id_type = self.df.schema[id_col].dataType
        self.work = Scratch(df.sparkSession, "jaccard-join")

    def run(self) -> DataFrame:
        """(row_id, size, component) per document."""
        work, percent = self.work, self.percent
        scanned = work.save(row_sets(self.df, self.n, self.id_col, self.text_col), "scanned")
        sets = scanned.filter("slice is null").select("row_id", "size", "sig1", "sig2")
        known = sets.filter("row_id is not null")
        self.unique = known.groupBy("row_id").count().filter("count > 1").isEmpty()
        key = ["size", "sig1", "sig2"]
        classes = work.save(known.filter("size > 0").groupBy(*key).agg(F.min("row_id").alias("rep")), "classes")
        n_classes = classes.count()
        load = load_classes(scanned, max(1, n_classes))
        reps = bounded(classes.select(F.col("rep").alias("row_id")), ID_BOUND, n_classes)
        heads = row_prefixes(self.df, self.n, percent, load, self.id_col, self.text_col)
        heads = heads.join(reps, "row_id", "left_semi")
        self.heads = work.save(heads if self.unique else heads.dropDuplicates(["row_id"]), "heads")
        entries = work.save(self.shared_entries(), "entries")
        work.drop("shared")
        work.release()
        tested = work.save(self.likely_by_prefix(self.by_ranges(self.stars(entries))), "stars")
        work.drop("star_pairs", "pairs", "wanted")
        work.release()
        links = work.save(self.verify(tested), "star_links")
        found = work.save(connected_components(links, work), "star_components")
        counted = self.counted(self.across(entries, found)).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        across = work.save(counted, "across")
        work.drop("heads", "stars", "rows", "split")
        work.release()
        more = work.save(self.verify(across), "more_links")
        edges = links.unionByName(more)
        self.links = edges
        self.entries, self.key, self.sets = entries, key, known
        final = work.save(connected_components(edges, work), "components")
        n_final = final.count()
        labelled = classes.join(bounded(final, ID_BOUND, n_final), F.col("rep") == F.col("node"), "left")
        labelled = work.save(labelled.select(*key, F.coalesce("component", "rep").alias("component")), "labelled")
        least = sets.join(bounded(labelled, ID_BOUND, n_classes), key, "left")
        component = F.when(F.col("row_id").isNotNull(), F.coalesce("component", "row_id"))
        return least.select("row_id", "size", component.alias("component"))

    def shared_entries(self) -> DataFrame:
        """(gram, row_id, size, pos, band, before, earlier, ranges, bits): prefix n-grams that another row of like size has too.

        Linked rows are of the same band of sizes or of neighbouring ones; an n-gram's bands are bits of a number
        (bands 64 apart share a bit, and where a band may have three rows all bands count: both keep more, never less).

        ``before`` counts a row's earlier ones; only those can have matched already, so at any shared n-gram an
        overlap is at most the smaller count plus the smaller rest.  ``earlier`` holds the last of them.
        """
        percent = self.percent
        band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
        entries = self.heads.select("row_id", "size", band.alias("band"), F.posexplode("grams").alias("pos", "gram"))
        bit = F.expr("shiftleft(1L, band % 64)")
        shared = entries.groupBy("gram").agg(F.count("*").alias("n"), F.bit_or(bit).alias("any"), F.bit_xor(bit).alias("odd")).filter("n > 1")
        near = "any & (shiftleft(any, 1) | shiftrightunsigned(any, 63) | shiftrightunsigned(any, 1) | shiftleft(any, 63))"
        shared = shared.select("gram", F.expr(f"if(n - bit_count(any) > bit_count(any & ~odd), any, (any & ~odd) | ({near}))").alias("bands"))
        shared = self.work.save(shared.filter("bands <> 0"), "shared")
        entries = entries.join(shared, "gram").filter(F.col("bands").bitwiseAND(bit) != 0).drop("bands")
        in_order = Window.partitionBy("row_id").orderBy("pos")
        entries = entries.withColumn("before", F.row_number().over(in_order) - 1)
        entries = entries.withColumn("earlier", F.collect_list("gram").over(in_order.rowsBetween(-EARLIER, -1)))
        least = F.expr(f"({percent} * size + 99) div 100")
        entries = entries.filter(F.col("before") + F.col("size") - F.col("pos") >= least)
        return entries.join(self.heads.select("row_id", "ranges", "bits"), "row_id")

    def stars(self, entries: DataFrame) -> DataFrame:
        """(a, b, size_a, size_b): pairs of each row with the pivots of its blocks, unless bounds rule them out.

        The pivot is the row with the fewest n-grams of its own before the block's: of many near copies the one that is
        changed least, which links most others.  Its id only decides between equal ones.
        """
        columns = ["row_id", "size", "pos", "before"]
        own = (F.col("pos") - F.col("before")).alias("own")
        pivots = entries.groupBy("gram", "band").agg(F.min(F.struct(own, *columns)).alias("p"), F.count("*").alias("n"))
        pivots = pivots.filter("n > 1").select("gram", "band", *[F.col(f"p.{c}").alias(f"{c}_b") for c in columns])
        rows = entries.select("gram", "band", *[F.col(c).alias(f"{c}_a") for c in columns])
        pairs = rows.join(pivots, ["gram", "band"]).filter((F.col("row_id_b") != F.col("row_id_a")) & self.fits())
        ordered = F.col("row_id_a") < F.col("row_id_b")
        size = [F.when(ordered, F.col(f"size_{x}")).otherwise(F.col(f"size_{y}")).alias(f"size_{x}") for x, y in ("ab", "ba")]
        pairs = pairs.select(F.least("row_id_a", "row_id_b").alias("a"), F.greatest("row_id_a", "row_id_b").alias("b"), *size)
        return pairs.distinct()

    def fits(self) -> Column:
        """Whether sizes and what can follow a shared n-gram of rows _a and _b leave room for a link."""
        rest = F.least("before_a", "before_b") + F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
        return _sizes_fit(self.percent, "size_a", "size_b") & (rest >= _need(self.percent, "size_a", "size_b"))

    def bits_fit(self) -> Column:
        """Whether the bits in which rows _a and _b differ leave room for a link: each shows an n-gram that only one of them has."""
        apart = sum((F.bit_count(F.col("bits_a")[f"w{k}"].bitwiseXOR(F.col("bits_b")[f"w{k}"])) for k in range(WORDS)), F.lit(0))
        return apart <= F.col("size_a") + F.col("size_b") - 2 * _need(self.percent, "size_a", "size_b")

    def ranges_fit(self) -> Column:
        """Whether the smaller counts per range of hashes leave room for a link."""
        base = [F.floor(F.col(f"size_{k}") / RANGES).cast("int") for k in "ab"]
        most = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x + base[0], y + base[1])), F.lit(0).cast("long"), lambda n, x: n + x)
        return F.coalesce(most, F.lit(1 << 40)) >= _need(self.percent, "size_a", "size_b")

    def counted(self, pairs: DataFrame) -> DataFrame:
        """(a, b, size_a, size_b) of the pairs that were made as often as the n-grams that a link must share."""
        made = pairs.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("n"))
        enough = F.least(F.lit(SHARED), F.expr(f"({self.percent} * least(size_a, size_b) + 99) div 100"))
        return made.filter(F.col("n") >= enough).drop("n")

    def by_ranges(self, pairs: DataFrame) -> DataFrame:
        pairs, ranges = self.work.save(pairs, "star_pairs"), self.heads.select("row_id", "ranges", "bits")
        for k in "ab":
            pairs = pairs.join(ranges.select(F.col("row_id").alias(k), F.col("ranges").alias(f"ranges_{k}"), F.col("bits").alias(f"bits_{k}")), k)
        return pairs.filter(self.bits_fit() & self.ranges_fit()).select("a", "b", "size_a", "size_b")

    def likely_by_prefix(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose prefixes overlap enough: the common n-grams of both, and all that can follow the last of them."""
        pairs = self.work.save(pairs, "pairs")
        wanted = self.work.save(pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct(), "wanted")
        heads = self.heads.select("row_id", "grams").join(bounded(wanted, ID_BOUND), "row_id", "left_semi")
        joined = pairs.join(heads.select(F.col("row_id").alias("a"), F.col("grams").alias("grams_a")), "a")
        joined = joined.join(heads.select(F.col("row_id").alias("b"), F.col("grams").alias("grams_b")), "b")
        joined = joined.withColumn("common", F.array_intersect("grams_a", "grams_b")).filter(F.size("common") > 0)
        after = [F.col(f"size_{k}") - F.array_position(f"grams_{k}", F.element_at("common", -1)) for k in "ab"]
        enough = F.least(F.lit(SHARED), F.expr(f"({self.percent} * least(size_a, size_b) + 99) div 100"))
        bound = F.size("common") + F.least(*after) >= _need(self.percent, "size_a", "size_b")
        return joined.filter((F.size("common") >= enough) & bound).select("a", "b", "size_a", "size_b")

    def link_counts(self) -> DataFrame:
        """(row_id, n_links): to how many other documents each document links; call it after ``run``.

        The product over prefix columns is taken within components as well, over one document of each class, so work
        grows with the number of linked classes.  Documents of a class link with each other and share their other links.
        """
        key, work = self.key, self.work
        docs = self.sets.select("row_id", *key).distinct()
        classes = work.save(docs.filter("size > 0").groupBy(*key).agg(F.min("row_id").alias("rep"), F.count("*").alias("n")), "counted_classes")
        a = self.entries.select("gram", *[F.col(c).alias(f"{c}_a") for c in ("row_id", "size", "pos")])
        b = self.entries.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("row_id", "size", "pos")])
        pairs = a.join(b, "gram").filter((F.col("row_id_a") < F.col("row_id_b")) & _sizes_fit(self.percent, "size_a", "size_b"))
        pairs = pairs.select(F.col("row_id_a").alias("a"), "size_a", "pos_a", F.col("row_id_b").alias("b"), "size_b", "pos_b")
        edges = work.save(self.verify(work.save(self.likely(pairs), "every_pair")), "every_link")
        both = edges.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("rep"), F.col("a").alias("other")))
        sizes = classes.select(F.col("rep").alias("other"), F.col("n").alias("m"))
        around = both.join(sizes, "other").groupBy("rep").agg(F.sum("m").alias("m"))
        per = classes.join(around, "rep", "left").select(*key, (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
        return docs.join(per, key, "left").select("row_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Sum partial overlaps per pair; drop pairs that share too few prefix n-grams or can't reach their bound.

        """
        ordered = F.col("a") < F.col("b")
        swap = lambda c: F.when(ordered, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
        back = lambda c: F.when(ordered, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
        fit = pairs.filter(_sizes_fit(self.percent, "size_a", "size_b")).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            swap("size").alias("size_a"), back("size").alias("size_b"), swap("pos").alias("pos_a"), back("pos").alias("pos_b"),
        )
        summed = fit.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("overlap"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
        most = F.col("overlap") + F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) - 1
        enough = F.least(F.lit(SHARED), F.expr(f"({self.percent} * least(size_a, size_b) + 99) div 100"))
        return summed.filter((F.col("overlap") >= enough) & (most >= _need(self.percent, "size_a", "size_b"))).select("a", "b", "size_a", "size_b")

    def across(self, entries: DataFrame, found: DataFrame) -> DataFrame:
        """Products within blocks that hold more than one component, across components only."""
        known = bounded(found, ID_BOUND)
        rows = entries.join(known, F.col("row_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "row_id"))
        split = rows.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        split = self.work.save(split.filter("low <> high").select("gram"), "split")
        rows = rows.join(split, "gram", "left_semi")
        columns = ["row_id", "size", "pos", "before", "earlier", "component", "ranges", "bits"]
        rows = self.work.save(rows.select("gram", *columns), "rows")
        a = rows.select("gram", *[F.col(c).alias(f"{c}_a") for c in columns])
        b = rows.select("gram", *[F.col(c).alias(f"{c}_b") for c in columns])
        seen = F.size(F.array_intersect("earlier_a", "earlier_b"))
        pairs = a.join(b, "gram").filter(
            (F.col("row_id_a") < F.col("row_id_b")) & (F.col("component_a") != F.col("component_b")) & self.fits() & self.bits_fit() & self.ranges_fit() & (seen < SHARED)
        )
        return pairs.select(F.col("row_id_a").alias("a"), F.col("row_id_b").alias("b"), "size_a", "size_b")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs whose full overlap meets the bound."""
        ids = self.work.save(pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct(), "ids")
        n_ids = ids.count()
        if n_ids == 0:
            kind = self.id_type
            return pairs.sparkSession.createDataFrame([], T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
        chosen = self.df.join(bounded(ids, ID_BOUND, n_ids), F.col(self.id_col) == F.col("row_id"), "left_semi")
        sets = self.work.save(full_sets(chosen, self.n, self.id_col, self.text_col), "sets")
        sets = sets if self.unique else sets.dropDuplicates(["row_id"])
        joined = pairs.join(sets.select(F.col("row_id").alias("a"), F.col("grams").alias("grams_a")), "a")
        joined = joined.join(sets.select(F.col("row_id").alias("b"), F.col("grams").alias("grams_b")), "b")
        overlap = F.size(F.array_intersect("grams_a", "grams_b"))
        out = self.work.save(joined.filter(overlap >= _need(self.percent, "size_a", "size_b")).select("a", "b"), "verified")
        self.work.drop("ids", "sets")
        self.work.release()
        return out


def jaccard_components(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, size, component) of every row; the component is its smallest id.

    Rows without an id link with nothing and have no component.  Where ids
    repeat, each different text of an id is a document of its own, and the
    component is the id of the smallest.  An empty table gives an empty result.
    """
    if repeated_ids(df, id_col).isEmpty():
        return JaccardJoin(df, n, percent, id_col, text_col).run()
    kind = df.schema[id_col].dataType
    keyed = df.select(id_and_text(df, id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    rows = JaccardJoin(keyed, n, percent, "__key", "__text").run()
    return rows.withColumn("row_id", id_of("row_id", kind)).withColumn("component", id_of("component", kind))
