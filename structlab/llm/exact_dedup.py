"""Exact deduplication by progressive refinement (DataFrame functions only).

Rows are grouped by byte length, the survivors by a hash of their prefix, and
only what still shares a key has its whole content digested and compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlab.llm.common import Scratch, bounded

#: Characters that the second level hashes.
PREFIX_CHARS = 256
#: Most keys of a level that are broadcast (about 16 bytes each); more are joined by a shuffle of digests.
KEY_BOUND = 1_000_000


def duplicate_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, key_bound: int = KEY_BOUND
) -> DataFrame:
    """Groups of two or more equal texts: digest, keep_id (largest id), group_size.

    Level 1 counts byte lengths, level 2 counts (length, prefix hash) among the
    lengths that repeat, level 3 digests the whole content of rows whose key
    repeats.  All three are aggregates that combine before the shuffle, so a
    third of all rows in one group is one row per task.  Texts never move:
    the keys of a level go to the rows (a broadcast of checked size), and
    beyond ``key_bound`` the rows' digests go to the keys.

    Null texts count as empty.  An empty table gives no groups.
    """
    work = Scratch(df.sparkSession, "exact-dedup")
    rows = df.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    sized = rows.withColumn("n_bytes", F.octet_length("body"))
    lengths = work.save(sized.groupBy("n_bytes").count().filter("count > 1").select("n_bytes"), "lengths")
    prefixed = sized.withColumn("prefix", F.xxhash64(F.substring("body", 1, prefix_chars)))
    level2 = prefixed.select("n_bytes", "prefix").join(bounded(lengths, key_bound), "n_bytes", "left_semi")
    keys = work.save(level2.groupBy("n_bytes", "prefix").count().filter("count > 1").drop("count"), "keys")
    n_keys = keys.count()
    if n_keys <= key_bound:
        level3 = prefixed.join(F.broadcast(keys), ["n_bytes", "prefix"], "left_semi")
        level3 = level3.select("row_id", F.sha2("body", 256).alias("digest"))
    else:
        level3 = prefixed.select("row_id", "n_bytes", "prefix", F.sha2("body", 256).alias("digest"))
        level3 = level3.join(keys, ["n_bytes", "prefix"], "left_semi").select("row_id", "digest")
    groups = level3.groupBy("digest").agg(F.max("row_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = work.save(groups.filter("group_size > 1"), "groups")
    work.drop("lengths", "keys")
    return groups


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bound: int = KEY_BOUND) -> DataFrame:
    """One row per input row: row_id, digest, keep_id, group_size, kept.

    Of equal texts the row with the largest id stays.  Repeated rows that share
    the kept id share its verdict (``kept`` is true for each; see
    ``corpus_pipeline`` for one row of them).  Null ids sort below all others;
    a group of null ids only has a null keep_id and is kept.
    """
    groups = duplicate_groups(df, id_col, text_col, key_bound=key_bound)
    rows = df.select(
        F.col(id_col).alias("row_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest")
    )
    joined = rows.join(bounded(groups, key_bound // 4), "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("row_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "row_id",
        "digest",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("row_id").eqNullSafe(keep).alias("kept"),
    )
