"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("structlab.scratch", None)
    if not root:
        root = tempfile.mkdtemp(prefix="structlab-")
        spark.conf.set("structlab.scratch", root)
    return root.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


class Scratch:
    """Tables written to the shared folder: lineage ends there, so a lost executor costs one task, not the job.

    ``drop`` frees a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished plans now; it does so when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, self.paths.pop(name))


def bounded(df: DataFrame, bound: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``bound`` rows; else as it is, for a shuffled join.

    ``df`` should be a written table, so that counting it is cheap.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= bound else df


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words by length arithmetic of two replacements: each run of non-space becomes one character."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), NOT_SPACE, "w")
    return F.length(F.regexp_replace(marked, SPACE, "")).cast("long")


def repeated_ids(df: DataFrame, id_col: str) -> DataFrame:
    """The ids that more than one row has, as a written table; usually there are none."""
    repeated = df.groupBy(id_col).count().filter((F.col("count") > 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"))
    return Scratch(df.sparkSession, "repeated").save(repeated, "ids")


def one_row_per_id(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``df`` without further rows of an id and a text that it holds already (rows without an id all stay).

    Different texts of one id are different rows.  Only rows whose id repeats are compared.
    """
    repeated = repeated_ids(df, id_col)
    if repeated.isEmpty():
        return df
    ids = bounded(repeated, 1_000_000)
    single = df.join(ids, F.col(id_col) == F.col("__id"), "left_anti")
    several = df.join(ids, F.col(id_col) == F.col("__id"), "left_semi").withColumn("__sha256", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    return single.unionByName(several.dropDuplicates([id_col, "__sha256"]).drop("__sha256"))


def id_and_text(df: DataFrame, id_col: str, text_col: str = "text") -> Column:
    """A string per row that sorts as its id (numbers as numbers), then as the digest of its text; null where the id is."""
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    shifted = (F.col(id_col).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string")
    key = F.lpad(shifted, 20, "0") if whole else F.col(id_col).cast("string")
    return F.concat(key, F.lit("\x01"), F.sha2(F.coalesce(text_col, F.lit("")), 256))


def id_of(key: str, kind: T.DataType) -> Column:
    """The id that ``id_and_text`` put into a key."""
    text = F.expr(f"substring({key}, 1, length({key}) - 65)")
    if isinstance(kind, T.IntegralType):
        return (text.cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast(kind)
    return text.cast(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
