"""Readers of token corpora, transliterations, genomes, catalogues, points and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structlab.functions.text import to_number

TOKENS = T.ArrayType(T.StringType())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path matches anything, asked of the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_or(spark: SparkSession, path: str, read, fallback) -> tuple[DataFrame, str]:
    """(read(path), "file") if the path exists and has rows, else (fallback(), "fallback")."""
    if exists(spark, path):
        df = read(spark, path)
        if not df.isEmpty():
            return df, "file"
    return fallback(), "fallback"


def sequence_map(spark: SparkSession, path: str, field: str = "sequences") -> DataFrame:
    """{field: {id: [token]}} as (seq, ord, token); empty sequences vanish."""
    schema = T.StructType([T.StructField(field, T.MapType(T.StringType(), TOKENS))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode(field).alias("seq", "tokens"))
    return rows.select("seq", F.posexplode("tokens").alias("ord", "token")).filter("token is not null")


def word_lists(spark: SparkSession, path: str, field: str = "words") -> DataFrame:
    """{field: [[token]]} as (seq, ord, token)."""
    schema = T.StructType([T.StructField(field, T.ArrayType(TOKENS))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode(field).alias("seq", "tokens"))
    return rows.select(F.col("seq").cast("string").alias("seq"), F.posexplode("tokens").alias("ord", "token")).filter("token is not null")


def site_sequences(spark: SparkSession, path: str, field: str) -> DataFrame:
    """{field: {sites: {site: {sequences: [[token]]}}}} as (site, seq, ord, token)."""
    site = T.StructType([T.StructField("sequences", T.ArrayType(TOKENS))])
    schema = T.StructType([T.StructField(field, T.StructType([T.StructField("sites", T.MapType(T.StringType(), site))]))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode(f"{field}.sites").alias("site", "s"))
    rows = rows.select("site", F.posexplode("s.sequences").alias("seq", "tokens"))
    return rows.select("site", F.concat_ws("/", "site", "seq").alias("seq"), F.posexplode("tokens").alias("ord", "token")).filter("token is not null")


def inscriptions(spark: SparkSession, path: str, field: str = "sequences") -> DataFrame:
    """{field: {id: {tokens, site, inscription}}} as (seq, site, inscription, ord, token)."""
    item = T.StructType([T.StructField("tokens", TOKENS), T.StructField("site", T.StringType()), T.StructField("inscription", T.StringType())])
    schema = T.StructType([T.StructField(field, T.MapType(T.StringType(), item))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode(field).alias("seq", "i"))
    return rows.select("seq", "i.site", "i.inscription", F.posexplode("i.tokens").alias("ord", "token")).filter("token is not null")


def split_rows(df: DataFrame, separator: str) -> DataFrame:
    """(seq, ord, token) cut into rows at a separator token: island numbers by a running count."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq").orderBy("ord")
    cut = df.withColumn("row", F.sum((F.col("token") == separator).cast("int")).over(w)).filter(F.col("token") != separator)
    return cut.select(F.concat_ws("/", "seq", "row").alias("seq"), (F.row_number().over(Window.partitionBy("seq", "row").orderBy("ord")) - 1).alias("ord"), "token")


def atf_tokens(lines: Column) -> Column:
    """Sign tokens of an ATF text line: null for structure and comment lines; line numbers, comments and determiners taken out."""
    body = F.regexp_replace(lines, r"^\s*\d+['\w]*\.\s*", "")
    body = F.regexp_replace(body, r"\(\$[^)]*\$\)|\{[^}]*\}|\s#.*$", " ")
    body = F.regexp_replace(body, r"[\[\]<>!?*#,;]", " ")
    tokens = F.filter(F.split(F.trim(body), r"\s+"), lambda t: ~t.isin("", "...", "x", "X", "|"))
    return F.when(~F.trim(lines).rlike(r"^([&@$#>=]|$)"), tokens)


def atf(spark: SparkSession, path: str) -> DataFrame:
    """(line, ord, token) of ATF files; lines are numbered within their file by Spark's text reader order."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return text.select("line", F.posexplode(atf_tokens(F.col("text"))).alias("ord", "token"))


def ivtff_line(lines: Column) -> Column:
    """Payload words of an IVTFF line: comments and page headers give null; <...> and {...} go, [a:b] is a, commas and points part words."""
    payload = F.regexp_replace(lines, r"^<[^>]*>\s*", "")
    payload = F.regexp_replace(payload, r"<[^>]*>|\{[^}]*\}", "")
    payload = F.regexp_replace(payload, r"\[([^:\]]*)(?::[^\]]*)*\]", "$1")
    words = F.filter(F.split(F.regexp_replace(payload, r"[?!%=\s-]", ""), r"[.,]"), lambda w: w != "")
    return F.when(lines.rlike(r"^<[^>]+>\s+\S") & ~lines.startswith("#"), words)


def ivtff(spark: SparkSession, path: str) -> DataFrame:
    """(folio, line, ord, token) of IVTFF files."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return text.select(F.regexp_extract("text", r"^<(\w+)", 1).alias("folio"), "line", F.posexplode(ivtff_line(F.col("text"))).alias("ord", "token"))


def xml_lines(spark: SparkSession, path: str, row_tag: str = "line") -> DataFrame:
    """Rows of an XML corpus by Spark's reader."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def fasta(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(label, seq) per record; ``most`` caps the bases of a record, as the format's users ask for heads of genomes."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", r"(?m)^>"), lambda r: F.trim(r) != "")).alias("r"))
    bases = F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s+", ""))
    return records.select(F.trim(F.regexp_extract("r", r"^([^\n]*)", 1)).alias("label"), (F.left(bases, F.lit(most)) if most else bases).alias("seq"))


def bed4(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """(chrom, start, end, type), 0-based half-open.  Strict: a bad row fails the query."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("track"))
    part = F.split("value", "\t")
    rows = lines.select(F.get(part, F.lit(0)).alias("chrom"), F.get(part, F.lit(1)).try_cast("long").alias("start"), F.get(part, F.lit(2)).try_cast("long").alias("end"), F.get(part, F.lit(3)).alias("type"), "value")
    ok = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & F.col("type").isNotNull()
    if types:
        ok = ok & F.col("type").isin(types)
    bad = F.raise_error(F.concat(F.lit("bad BED4 row: "), "value")).cast("string")
    return rows.select(F.when(F.coalesce(ok, F.lit(False)), F.col("chrom")).otherwise(bad).alias("chrom"), "start", "end", "type")


def space_table(spark: SparkSession, path: str, columns: list[tuple[str, str]], least: int | None = None) -> DataFrame:
    """Columns separated by white space; comments and rows that don't parse are skipped."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).filter(F.size(part) >= (least or len(columns)))
    rows = lines.select(*[F.get(part, F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(columns)])
    return rows.dropna(subset=[name for name, kind in columns if kind != "string"])


def pick(df: DataFrame, names: list[str]) -> Column | None:
    """The first column whose name is among ``names``, case aside; None if there is none."""
    have = {c.lower().strip(): c for c in df.columns}
    return next((F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have), None)


def alias_csv(spark: SparkSession, path: str, schema: dict[str, tuple[list[str], str]], essential: list[str]) -> DataFrame:
    """CSV with columns found by alias: {name: (aliases, type)}.

    Missing optional columns are null; a missing essential one gives an empty
    table; rows without an essential value are dropped.
    """
    raw = spark.read.option("header", True).csv(path)
    found = {name: pick(raw, [name, *aliases]) for name, (aliases, _) in schema.items()}
    cell = lambda c, kind: to_number(c).cast(kind) if kind in ("double", "float") else F.trim(c).try_cast(kind)
    cols = [(cell(found[n], kind) if found[n] is not None else F.lit(None).cast(kind)).alias(n) for n, (_, kind) in schema.items()]
    out = raw.select(*cols)
    if any(found[n] is None for n in essential):
        return out.filter(F.lit(False))
    out = out.dropna(subset=essential)
    texts = [n for n in essential if schema[n][1] == "string"]
    for n in texts:
        out = out.filter(F.col(n) != "")
    return out


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, type) with rows that aren't numbers left out."""
    return alias_csv(
        spark, path,
        {"lat": (["latitude", "y"], "double"), "lon": (["lng", "long", "longitude", "x"], "double"), "type": (["class", "kind"], "string")},
        ["lat", "lon"],
    )


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, properties) of the Point features of GeoJSON files."""
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("geometry", geometry), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])
    schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).filter("f.geometry.type = 'Point'")
    xy = F.from_json("f.geometry.coordinates", "array<double>")
    return rows.select(F.get(xy, F.lit(0)).alias("lon"), F.get(xy, F.lit(1)).alias("lat"), F.col("f.properties").alias("properties")).dropna(subset=["lon", "lat"])


def node_edge_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON map with both."""
    whole = spark.read.json(path, multiLine=True)
    return whole.select(F.inline("nodes")), whole.select(F.inline("edges"))


def catalog(spark: SparkSession, path: str, field: str = "domains") -> DataFrame:
    """Rows of an array of records in one JSON file."""
    return spark.read.json(path, multiLine=True).select(F.inline(field))


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of report files, found recursively, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "length")


def path_corpus(df: DataFrame, path_col: str) -> DataFrame:
    """(seq, ord, token) of rows named site/inscription_sign.ext in a path-like column, in file-name order."""
    from pyspark.sql import Window

    parts = F.split(path_col, "/")
    stem = F.element_at(F.split(F.element_at(parts, -1), r"\."), 1)
    rows = df.select(F.element_at(parts, 1).alias("site"), F.element_at(F.split(stem, "_"), 1).alias("inscription"), F.element_at(F.split(stem, "_"), -1).alias("token"), F.col(path_col).alias("__p"))
    seq = F.concat_ws("/", "site", "inscription")
    return rows.select(seq.alias("seq"), (F.row_number().over(Window.partitionBy(seq).orderBy("__p")) - 1).alias("ord"), "token")


def lab_values(text: Column, patterns: dict[str, str]) -> Column:
    """struct of the first group of each pattern in a report text, as numbers."""
    return F.struct(*[F.regexp_extract(text, p, 1).try_cast("double").alias(n) for n, p in patterns.items()])
