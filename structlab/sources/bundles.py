"""Bundled and cached records by a data source of their own: ``spark.read.format("bundle")``.

Where records come from is resolved in a stated order, and each row says which
it was: a test hook that forces an outcome, a cache, a bundle, nothing.  Each
file is a partition.  Records may be of several shapes; one that fits none is a
row that names what is wrong with it, or an error if ``on_error`` is raise.
"""

from __future__ import annotations

import csv
import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from structlab.sources.readers import atf_tokens

ENDS = "file string, record int, error string, provenance string"
#: What each kind of record has.
SCHEMAS = {
    "sequences": f"id string, genre string, tokens array<string>, atf string, {ENDS}",
    "times": f"name string, t double, {ENDS}",
    "bursts": f"name string, t double, {ENDS}",
}
# Names of the columns of burst tables, first match wins.
BURST_NAMES = ("tns_name", "name", "frb_name", "transient_name", "source", "source_name")
BURST_TIMES = ("mjd", "peak_mjd", "arrival_mjd", "utc_mjd", "dm_phase_mjd", "peak_time_mjd", "toa_mjd")


def files_at(path: str | None) -> list[str]:
    """Files that a path, a folder or a pattern names, in order; empty files don't count."""
    if not path:
        return []
    path = path.removeprefix("file://")
    found = [p for q in sorted(glob.glob(path)) for p in ([os.path.join(q, n) for n in sorted(os.listdir(q))] if os.path.isdir(q) else [q])]
    return [p for p in found if os.path.isfile(p) and os.path.getsize(p)]


def resolve(options: dict[str, str]) -> tuple[str, list[str]]:
    """(provenance, files): the hook's word and no files, else the cache's, else the bundle's, else EMPTY."""
    if options.get("hook"):
        return options["hook"], []
    for name, provenance in (("cache", "CACHED"), ("bundle", "USER_OVERRIDE")):
        files = files_at(options.get(name))
        if files:
            return provenance, files
    return "EMPTY", []


@dataclass
class BundleFile(InputPartition):
    path: str
    provenance: str


def items_of(whole: object) -> list:
    """The records of a bundle: a list, the list of a ``tablets`` field, all lists among the fields, or the one record."""
    if isinstance(whole, list):
        return whole
    if isinstance(whole, dict):
        if isinstance(whole.get("tablets"), list):
            return whole["tablets"]
        return [x for v in whole.values() if isinstance(v, list) and "tokens" not in whole for x in v] or [whole]
    return [whole]


def sequence_rows(whole: object) -> Iterator[tuple]:
    for k, item in enumerate(items_of(whole)):
        if not isinstance(item, dict):
            yield None, None, None, None, k, f"record {k}: {type(item).__name__} in place of an object"
            continue
        name, genre, tokens, atf = item.get("cdli_id", "?"), item.get("script_genre"), item.get("tokens"), item.get("atf")
        error = None
        if atf is not None and not isinstance(atf, str):
            error = f"record {k}: atf is {type(atf).__name__}"
        elif atf is None and not (isinstance(tokens, list) and all(isinstance(t, str) or t is None for t in tokens)):
            error = f"record {k}: neither atf nor a list of tokens"
        good = error is None
        yield str(name), genre and str(genre), tokens if good and atf is None else None, atf if good else None, k, error


def time_rows(whole: object) -> Iterator[tuple]:
    """A list of numbers, or a list of objects with ``mjd``; a mixture is as wrong as anything else."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if not isinstance(whole, list):
        yield None, None, 0, f"top level: {type(whole).__name__} in place of a list"
    elif all(map(number, whole)):
        yield from ((None, float(x), k, None) for k, x in enumerate(whole))
    elif all(isinstance(x, dict) and "mjd" in x for x in whole):
        for k, x in enumerate(whole):
            yield (x.get("name") and str(x["name"]), float(x["mjd"]), k, None) if number(x["mjd"]) else (None, None, k, f"record {k}: mjd is no number")
    else:
        k = next(k for k, x in enumerate(whole) if number(x) != number(whole[0]) or not (number(x) or isinstance(x, dict) and "mjd" in x))
        yield None, None, k, f"record {k}: neither all numbers nor all objects with mjd"


def burst_rows(text: str) -> Iterator[tuple]:
    """Rows of a table whose columns go by several names; without both columns there is nothing, and a time that is no number is null."""
    rows = csv.reader(text.splitlines())
    heads = [h.strip().lower() for h in next(rows, [])]
    name, time = (next((heads.index(c) for c in names if c in heads), None) for names in (BURST_NAMES, BURST_TIMES))
    if name is None or time is None:
        yield None, None, 0, "header: no column for " + ("the name" if name is None else "the time")
        return
    for k, row in enumerate(rows):
        if len(row) <= name or not row[name].strip():
            continue
        try:
            t = float(row[time])
        except (ValueError, IndexError):
            t = None
        yield row[name].strip(), t, k, None


class BundleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.kind = self.options.get("kind", "sequences")

    def partitions(self) -> list[BundleFile]:
        provenance, files = resolve(self.options)
        return [BundleFile(p, provenance) for p in files]

    def read(self, partition: BundleFile) -> Iterator[tuple]:
        if not partition.path:  # nothing to read; Spark asks for one partition at least
            return
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        width = 4 if self.kind == "sequences" else 2
        try:
            made = burst_rows(text) if self.kind == "bursts" else (sequence_rows if self.kind == "sequences" else time_rows)(json.loads(text))
        except json.JSONDecodeError as e:
            made = iter([(*[None] * width, 0, f"not JSON: {e.msg} at {e.pos}")])
        for row in made:
            if row[-1] is not None and self.options.get("on_error") == "raise":
                raise ValueError(f"{partition.path}: {row[-1]}")
            word = partition.provenance if row[-1] is None else f"{partition.provenance}_INVALID"
            yield (*row[:-2], partition.path, row[-2], row[-1], word)


class BundleSource(DataSource):
    """Options: kind (sequences, times, bursts), hook, cache, bundle, on_error (keep, raise).  Paths must be seen by driver and executors."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "sequences")]

    def reader(self, schema) -> BundleReader:
        return BundleReader(dict(self.options))


def read_bundle(spark: SparkSession, kind: str, **options: str) -> tuple[DataFrame, str]:
    """(rows, provenance); without any file the rows are empty and the provenance says why."""
    provenance, files = resolve(options)
    if not files:
        return spark.createDataFrame([], SCHEMAS[kind]), provenance
    spark.dataSource.register(BundleSource)
    reader = spark.read.format("bundle").option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(), provenance


def bundled_tokens(spark: SparkSession, **options: str) -> DataFrame:
    """(file, seq, genre, ord, token, provenance) of the valid records of sequence bundles; ATF texts are cut into signs."""
    rows, _ = read_bundle(spark, "sequences", **options)
    cut = F.flatten(F.filter(F.transform(F.split("atf", r"\r?\n"), atf_tokens), lambda t: t.isNotNull()))
    tokens = F.when(F.col("atf").isNotNull(), cut).otherwise(F.col("tokens"))
    rows = rows.filter("error is null").select("file", F.concat_ws("/", "id", "record").alias("seq"), "genre", F.posexplode(tokens).alias("ord", "token"), "provenance")
    return rows.filter("token is not null")
