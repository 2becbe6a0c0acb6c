"""Readers over files that are written from the tables first: what comes back is held against the tables themselves.

Each file holds a bounded number of rows (a hundred keys a bucket, a fixed
number of buckets), so files grow in number, not in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlab.plans.registry import query, r6, shared_dir, sql_uniform, table
from structlab.sources import readers

#: Keys per bucket (a document, where a format has such), and buckets per file.
PER_FILE, BUCKETS = 100, 64


def bucket(key: str) -> Column:
    return F.expr(f"{key} div {PER_FILE}").alias("bucket")


def put(df: DataFrame, name: str) -> str:
    """Text files from rows (bucket, value) in a new shared folder, each of ``BUCKETS`` buckets: their lines in order of ``place``, or an array of their JSON documents."""
    path, lines = shared_dir(df.sparkSession, name), "place" in df.columns
    parts = F.struct("bucket", *(["place"] if lines else []), "value")
    files = df.groupBy(F.expr(f"bucket div {BUCKETS}").alias("file")).agg(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["value"]).alias("v"))
    value = F.array_join("v", "\n") if lines else F.concat(F.lit("["), F.array_join("v", ",\n"), F.lit("]"))
    files.select("file", value.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


def user_sequences(spark, sf_dir):
    """(bucket, id, tokens): each user's event types in order of event."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))  # a user's events
    return e.select(bucket("user_id"), F.col("user_id").cast("string").alias("id"), F.col("e.event_type").alias("tokens"))


def whole(fields: dict[str, Column], by: list[str] = ("bucket",)) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value")


USERS = "WITH t AS (SELECT user_id::VARCHAR AS seq, event_type AS token, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events)"
SUMS = "count(*) AS n, sum((ord + 1) * length(token))::BIGINT AS weighted"


def sums(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("ord") + 1) * F.length("token")).alias("weighted"))


@query(f"{USERS} SELECT seq, {SUMS} FROM t GROUP BY seq")
def read_sequence_map(spark, sf_dir):
    """Keyed sequences in JSON."""
    docs = user_sequences(spark, sf_dir).groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("id", "tokens"))).alias("sequences"))
    return sums(readers.sequence_map(spark, put(docs.select("bucket", whole({"sequences": F.col("sequences")})), "map")), "seq")


@query(f"{USERS}, b AS (SELECT *, dense_rank() OVER (PARTITION BY seq::BIGINT // 100 ORDER BY seq) - 1 AS k FROM t) SELECT k::VARCHAR AS seq, {SUMS} FROM b GROUP BY k")
def read_word_lists(spark, sf_dir):
    """Lists of words in JSON; a list is named by its place in its file."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("id", "tokens"))), lambda x: x["tokens"])
    docs = user_sequences(spark, sf_dir).groupBy("bucket").agg(lists.alias("words"))
    return sums(readers.word_lists(spark, put(docs.select("bucket", whole({"words": F.col("words")})), "words")), "seq")


@query("""
    WITH o AS (SELECT c_nationkey::VARCHAR AS site, o_custkey, o_orderpriority AS token, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT site, count(*) AS n, sum((ord + 1) * length(token))::BIGINT AS weighted FROM o GROUP BY site
""")
def read_site_sequences(spark, sf_dir):
    """Sequences nested by site in JSON: each customer's order priorities, by nation."""
    o = customer_orders(spark, sf_dir).groupBy("bucket", "site").agg(F.struct(F.collect_list("tokens").alias("sequences")).alias("s"))
    docs = o.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("site", "s"))).alias("sites"))
    path = put(docs.select("bucket", whole({"fixture": F.struct("sites")})), "sites")
    return sums(readers.site_sequences(spark, path, "fixture"), "site")


def customer_orders(spark, sf_dir):
    """(bucket, site, id, tokens): each customer's order priorities in order."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("site"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("e"))  # a customer's orders
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(bucket("o_custkey"), "site", F.col("o_custkey").cast("string").alias("id"), F.col("e.o_orderpriority").alias("tokens"))


@query("""
    WITH o AS (SELECT c_nationkey::VARCHAR AS site, o_custkey, o_orderpriority AS token, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT site, 'C' || o_custkey AS inscription, count(*) AS n, sum((ord + 1) * length(token))::BIGINT AS weighted FROM o GROUP BY ALL
""")
def read_inscriptions(spark, sf_dir):
    """Keyed records of tokens, site and inscription in JSON."""
    item = F.struct("tokens", "site", F.concat(F.lit("C"), "id").alias("inscription"))
    docs = customer_orders(spark, sf_dir).groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("id", item))).alias("sequences"))
    return sums(readers.inscriptions(spark, put(docs.select("bucket", whole({"sequences": F.col("sequences")})), "inscriptions")), "site", "inscription")


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, unnest(['M' || (l_partkey % 50), l_quantity::INT || '(N01)']) AS token, unnest([0, 1]) AS ord FROM lineitem)
    SELECT token, count(*) AS n, sum((ord + 1) * length(token))::BIGINT AS weighted FROM t GROUP BY token
""")
def read_atf(spark, sf_dir):
    """Transliterations: a tablet per order, with headers, structure lines, damage signs and comments about the signs."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("M"), F.col("l_partkey") % 50).alias("sign"), F.col("l_quantity").cast("int").alias("q"))
    line = F.concat("l_linenumber", F.lit(". {d}["), "sign", F.lit("]# ... , ("), F.lit("$ blank $) "), "q", F.lit("(N01)? # a comment"))
    lines = l.select(bucket("l_orderkey"), F.struct("l_orderkey", "l_linenumber").alias("place"), line.alias("value"))
    heads = l.select("l_orderkey").distinct().select(bucket("l_orderkey"), F.struct("l_orderkey", F.lit(0).alias("l_linenumber")).alias("place"), F.concat(F.lit("&P"), "l_orderkey", F.lit(" = order\n@tablet\n$ ruling\n# a note\n")).alias("value"))
    return sums(readers.atf(spark, put(lines.unionByName(heads), "atf")), "token")


@query("""
    WITH t AS (SELECT 'f' || p_size AS folio, unnest(string_split(p_name, ' ')) AS token, unnest(range(0, len(string_split(p_name, ' ')))) AS ord FROM part)
    SELECT folio, token, count(*) AS n, sum((ord + 1) * length(token))::BIGINT AS weighted FROM t GROUP BY ALL
""")
def read_ivtff(spark, sf_dir):
    """Interlinear lines: words parted by points, with alternatives, markup and page headers."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.split("p_name", " ").alias("w"))
    words = F.array_join(F.transform("w", lambda x: F.concat(F.lit("["), x, F.lit(":q]{&1}"))), ".")
    lines = p.select(bucket("p_partkey"), F.col("p_partkey").alias("place"), F.concat(F.lit("# note\n<f"), "p_size", F.lit("> <! page>\n<f"), "p_size", F.lit(".1,@P0> <%>"), words, F.lit("<$>")).alias("value"))
    return sums(readers.ivtff(spark, put(lines, "ivtff")), "folio", "token")


BASES = "translate(md5('{0}' || s_suppkey), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""
    WITH s AS (SELECT 'SUP' || s_suppkey || ' ' || s_name AS label, {BASES.format("a")} || {BASES.format("b")} AS seq FROM supplier)
    SELECT label, length(seq) AS n_bases, md5(seq) AS digest, round(len(regexp_extract_all(seq, '[GC]')) / 64.0, 6) + 0.0 AS gc FROM s
""")
def read_fasta(spark, sf_dir):
    """Genomes in lines of ten bases, lower and upper case, and their share of G and C."""
    from structlab.functions import text

    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.expr(BASES.format("a")).alias("a"), F.expr(f"lower({BASES.format('b')})").alias("b"))
    body = F.regexp_replace(F.concat("a", "b"), "(.{10})", "$1\n")
    records = s.select(bucket("s_suppkey"), F.col("s_suppkey").alias("place"), F.concat(F.lit(">SUP"), "s_suppkey", F.lit(" "), "s_name", F.lit("\n"), body).alias("value"))
    out = readers.fasta(spark, put(records, "fasta"))
    return out.select("label", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"), r6(text.gc_content(F.col("seq"))).alias("gc"))


@query("""
    SELECT event_type AS chrom, CASE WHEN value > 25 THEN 'high' ELSE 'low' END AS type, count(*) AS n, sum(event_id)::BIGINT AS starts, sum(event_id + 1 + user_id)::BIGINT AS ends FROM events GROUP BY ALL
""")
def read_bed4(spark, sf_dir):
    """Half-open regions with comments and track lines; a bad row would fail the query."""
    kind = F.when(F.col("value") > 25, "high").otherwise("low")
    row = F.concat_ws("\t", "event_type", "event_id", F.col("event_id") + 1 + F.col("user_id"), kind)
    lines = table(spark, sf_dir, "events").select(bucket("event_id"), F.col("event_id").alias("place"), F.when(F.col("event_id") % PER_FILE == 0, F.concat(F.lit("# regions\ntrack name=x\n\n"), row)).otherwise(row).alias("value"))
    out = readers.bed4(spark, put(lines, "bed"), ["high", "low"])
    return out.groupBy("chrom", "type").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query("SELECT s_nationkey::INT AS flag, count(*) AS n, round(sum(s_acctbal), 2) + 0.0 AS total FROM supplier WHERE s_acctbal >= 0 GROUP BY ALL")
def read_space_table(spark, sf_dir):
    """Measurements between runs of white space; comments and rows whose numbers don't parse are skipped."""
    s = table(spark, sf_dir, "supplier")
    number = F.when(F.col("s_acctbal") < 0, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    lines = s.select(bucket("s_suppkey"), F.col("s_suppkey").alias("place"), F.concat(F.lit("# c\n  "), F.lit("J"), "s_suppkey", F.lit("   "), number, F.lit("\t"), "s_nationkey").alias("value"))
    out = readers.space_table(spark, put(lines, "space"), [("name", "string"), ("v", "double"), ("flag", "int")])
    return out.groupBy("flag").agg(F.count("*").alias("n"), r6(F.sum("v"), 2).alias("total"))


SITE = f"""s AS (SELECT c_custkey AS k, c_mktsegment AS kind, floor(-60e4 + 120e4 * {sql_uniform("'site'", "c_custkey::VARCHAR")}) / 1e4 AS lat, floor(-180e4 + 360e4 * {sql_uniform("'site'", "c_custkey::VARCHAR", lane=1)}) / 1e4 AS lon FROM customer)"""


def rounded_sites(spark, sf_dir):
    from structlab.functions.rng import uniform

    c = table(spark, sf_dir, "customer")
    at = lambda low, size, lane: F.floor(low * 1e4 + size * 1e4 * uniform("site", F.col("c_custkey"), lane=lane)) / 1e4
    return c.select("c_custkey", F.col("c_mktsegment").alias("kind"), at(-60.0, 120.0, 0).alias("lat"), at(-180.0, 360.0, 1).alias("lon"))


@query(f"WITH {SITE} SELECT kind AS type, count(*) AS n, round(sum(lat), 4) + 0.0 AS lats, round(sum(lon), 4) + 0.0 AS lons FROM s WHERE lat > -50 GROUP BY ALL")
def read_points_csv(spark, sf_dir):
    """Points whose columns go by other names; rows that aren't numbers are left out."""
    rows = rounded_sites(spark, sf_dir)
    path = shared_dir(spark, "points")
    rows.select(F.when(F.col("lat") <= -50, "unknown").otherwise(F.col("lat").cast("string")).alias("Latitude"), F.col("lon").alias("LNG"), F.col("kind").alias("Class"), F.lit("x").alias("note")).write.option("header", True).csv(path)
    return readers.points_csv(spark, path).groupBy("type").agg(F.count("*").alias("n"), r6(F.sum("lat"), 4).alias("lats"), r6(F.sum("lon"), 4).alias("lons"))


@query(f"WITH {SITE} SELECT kind, count(*) AS n, round(sum(lat), 4) + 0.0 AS lats, round(sum(lon), 4) + 0.0 AS lons FROM s WHERE k % 3 <> 0 GROUP BY ALL")
def read_geojson(spark, sf_dir):
    """Point features among other geometries (every third site is a line and isn't read as a point)."""
    rows = rounded_sites(spark, sf_dir)
    point = F.concat(F.lit('{"type": "Point", "coordinates": ['), "lon", F.lit(", "), "lat", F.lit("]}"))
    line = F.concat(F.lit('{"type": "LineString", "coordinates": [['), "lon", F.lit(", "), "lat", F.lit("], [0, 0]]}"))
    feature = F.concat(F.lit('{"type": "Feature", "geometry": '), F.when(F.col("c_custkey") % 3 == 0, line).otherwise(point), F.lit(', "properties": {"kind": "'), "kind", F.lit('"}}'))
    docs = rows.select(bucket("c_custkey"), feature.alias("f")).groupBy("bucket").agg(F.concat(F.lit('{"features": ['), F.array_join(F.collect_list("f"), ", "), F.lit("]}")).alias("value"))
    out = readers.geojson_points(spark, put(docs, "geojson")).select(F.col("properties.kind").alias("kind"), "lat", "lon")
    return out.groupBy("kind").agg(F.count("*").alias("n"), r6(F.sum("lat"), 4).alias("lats"), r6(F.sum("lon"), 4).alias("lons"))


@query("""
    WITH n AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier), e AS (SELECT DISTINCT l_suppkey AS source, p_size AS target FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT round(sum(v), 2) FROM n) AS total, count(*) AS n_edges, sum(source * target)::BIGINT AS products FROM e
""")
def read_node_edge_graph(spark, sf_dir):
    """Maps of nodes and edges in JSON."""
    n = table(spark, sf_dir, "supplier").select(bucket("s_suppkey"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")).alias("n")).groupBy("bucket").agg(F.collect_list("n").alias("nodes"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    e = table(spark, sf_dir, "lineitem").join(p, "l_partkey").select("l_suppkey", "p_size").distinct()
    e = e.select(bucket("l_suppkey"), F.struct(F.col("l_suppkey").alias("source"), F.col("p_size").alias("target")).alias("e")).groupBy("bucket").agg(F.collect_list("e").alias("edges"))
    nodes, edges = readers.node_edge_graph(spark, put(n.join(e, "bucket").select("bucket", F.to_json(F.struct("nodes", "edges")).alias("value")), "graph"))
    one = nodes.agg(F.count("*").alias("n_nodes"), F.round(F.sum("v"), 2).alias("total"))
    return one.crossJoin(edges.agg(F.count("*").alias("n_edges"), F.sum(F.col("source") * F.col("target")).alias("products")))  # one row each


@query("SELECT n_name AS domain, n_regionkey::BIGINT AS verdict, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def read_catalog(spark, sf_dir):
    """A catalogue of records in JSON files, and the list of those files."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").count()
    rows = table(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"))
    item = F.struct(F.col("n_name").alias("domain"), F.col("n_regionkey").alias("verdict"), F.col("count").alias("n"))
    docs = rows.groupBy(F.col("n_regionkey").alias("bucket")).agg(F.collect_list(item).alias("domains"))
    return readers.catalog(spark, put(docs.select("bucket", whole({"domains": F.col("domains")})), "catalog")).select("domain", "verdict", "n")


@query("""
    WITH t AS (SELECT p_brand AS site, p_size AS inscription, p_partkey AS k FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY site, inscription ORDER BY site || '/' || inscription || '_S' || k || '.png') - 1 AS ord FROM t)
    SELECT site || '/' || inscription AS seq, count(*) AS n, sum((ord + 1) * (length(k::VARCHAR) + 1))::BIGINT AS weighted FROM o GROUP BY ALL
""")
def read_path_corpus(spark, sf_dir):
    """Sequences from file names: site, inscription and sign."""
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_size", F.lit("_S"), "p_partkey", F.lit(".png")).alias("path"))
    return sums(readers.path_corpus(p, "path"), "seq")


@query("""
    WITH r AS (SELECT s_suppkey AS k, s_acctbal AS moisture, s_nationkey AS nodes FROM supplier) SELECT k % 7 AS report, count(moisture) AS n, round(sum(moisture), 2) + 0.0 AS moisture, sum(nodes)::BIGINT AS nodes FROM r GROUP BY ALL
""")
def read_lab_values(spark, sf_dir):
    """Numbers found in report texts by patterns."""
    s = table(spark, sf_dir, "supplier")
    body = F.concat(F.lit("Report\nmoisture: "), F.col("s_acctbal").cast("decimal(12,2)"), F.lit(" %\nnode count = "), "s_nationkey", F.lit(" (seen twice)"))
    v = readers.lab_values(F.col("body"), {"moisture": r"moisture:\s*(-?[0-9.]+)", "nodes": r"node count = (\d+)", "other": r"absent (\d+)"})
    rows = s.select((F.col("s_suppkey") % 7).alias("report"), body.alias("body")).select("report", v.alias("v")).filter("v.other is null")
    return rows.groupBy("report").agg(F.count("v.moisture").alias("n"), r6(F.sum("v.moisture"), 2).alias("moisture"), F.sum("v.nodes").cast("long").alias("nodes"))


@query(f"{USERS}, c AS (SELECT *, sum((token = 'error')::INT) OVER (PARTITION BY seq ORDER BY ord) AS row FROM t), d AS (SELECT *, row_number() OVER (PARTITION BY seq, row ORDER BY ord) - 1 AS o FROM c WHERE token <> 'error') SELECT seq || '/' || row AS seq, count(*) AS n, sum((o + 1) * length(token))::BIGINT AS weighted FROM d GROUP BY ALL")
def read_split_rows(spark, sf_dir):
    """Sequences cut into rows at a separator."""
    u = user_sequences(spark, sf_dir).select(F.col("id").alias("seq"), F.posexplode("tokens").alias("ord", "token"))
    return sums(readers.split_rows(u, "error"), "seq")
