"""Joins, grouping sets, catalogue folds, classifiers and streams over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from structlab.functions import dates
from structlab.operators import fit, joins, vectors
from structlab.plans.registry import checkpoints, query, r6, shared_dir, table
from structlab.shared import settled

#: Query vectors that one broadcast holds, in expectation.
QUERY_BLOCK = 50_000


@query("""
    SELECT c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    GROUP BY GROUPING SETS ((), (c_mktsegment), (n_name))
""")
def grouping_sets_market(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.groupingSets([[], ["c_mktsegment"], ["n_name"]], "c_mktsegment", "n_name")
    return out.agg(F.count("*").alias("n"), r6(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT r_name, n_name, count(*) AS n, round(avg(c_acctbal), 6) + 0.0 AS mean_balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def rollup_region_nation(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("mean_balance"))


@query("""
    SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment
""")
def pivot_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0, ["F", "O", "P"])


@query("""
    SELECT DISTINCT p_partkey FROM part, supplier WHERE abs(p_retailprice - s_acctbal) <= 2.0
""")
def band_semi_join(spark, sf_dir):
    """Peaks within a tolerance of known frequencies."""
    out = joins.band_semi_join(table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), "p_retailprice", "s_acctbal", 2.0)
    return out.select("p_partkey")


@query("""
    SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
""")
def anti_join_filter(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


def windows_and_spans(orders, lineitem):
    day = lambda c: F.expr(f"timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', {c})").cast("long")
    a = orders.select(F.col("o_orderkey").alias("id"), day("o_orderdate").alias("s"), (day("o_orderdate") + 10).alias("e"))
    b = lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), day("l_shipdate").alias("s"), (day("l_shipdate") + 1 + F.col("l_linenumber")).alias("e"))
    return a, b


@query("""
    WITH a AS (SELECT o_orderkey AS id, (epoch_us(o_orderdate) / 86400000000)::BIGINT AS s, (epoch_us(o_orderdate) / 86400000000)::BIGINT + 10 AS e FROM orders),
         b AS (SELECT l_orderkey * 10 + l_linenumber AS id, (epoch_us(l_shipdate) / 86400000000)::BIGINT AS s, (epoch_us(l_shipdate) / 86400000000)::BIGINT + 1 + l_linenumber AS e FROM lineitem),
         o AS (SELECT a.id AS left_id, b.id AS right_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap, abs(a.s - b.s) AS off FROM a JOIN b ON a.s < b.e AND b.s < a.e)
    SELECT left_id, arg_min(right_id, (-overlap, off, right_id)) AS right_id, max(overlap)::BIGINT AS overlap, count(*) > 1 AS straddles FROM o GROUP BY left_id
""")
def interval_overlap_bins(spark, sf_dir):
    """All order windows against all shipping spans."""
    a, b = windows_and_spans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    return joins.best_overlap_whole(a, b, "s", "e", 30)


@query("""
    SELECT e.event_id, o.o_orderkey AS right_o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate
""")
def asof_last_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.asof_join(e, o, ["user_id"], "ts", ["o_orderkey"]).select("event_id", "right_o_orderkey")


@query("""
    WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q.vec_id AS a, e.vec_id AS b, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: power(p[1]::DOUBLE - p[2]::DOUBLE, 2))) AS d2 FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
    SELECT a AS vec_id, arg_min(b, (d2, b)) AS nearest, round(sqrt(min(d2)), 5) + 0.0 AS distance FROM d GROUP BY a
""")
def embedding_nn(spark, sf_dir):
    """Nearest other vector of a stated query set (ids divisible by 100) against all rows.

    Rows stay where they are and queries come to them by broadcasts of bounded size; what is shuffled is a row per task and query.
    """
    e = table(spark, sf_dir, "embeddings")
    q = settled(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")))
    rows = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
    blocks = -(-q.count() // QUERY_BLOCK) or 1  # of about QUERY_BLOCK vectors
    best = vectors.nearest_vectors(q, rows, blocks)
    return best.select(F.col("a").alias("vec_id"), F.col("b").alias("nearest"), r6(F.sqrt("d2"), 5).alias("distance"))


@query("""
    WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders), m AS (SELECT o_orderkey, (d - DATE '2000-01-06') + 0.5 - (18 + 14 / 60) / 24 AS x FROM d)
    SELECT o_orderkey, round((1 - cos(2 * pi() * (x - 29.530588853 * floor(x / 29.530588853)) / 29.530588853)) / 2, 6) + 0.0 AS lit FROM m
""")
def lunar_illumination_orders(spark, sf_dir):
    return lit(table(spark, sf_dir, "orders"))


def lit(rows):
    return rows.select("o_orderkey", r6(dates.lunar_illumination(F.col("o_orderdate").cast("date"))).alias("lit"))


@query("""
    SELECT o_orderkey, julian(o_orderdate::DATE::TIMESTAMP)::DOUBLE - 0.5 AS jd FROM orders
""")
def julian_day_orders(spark, sf_dir):
    return julian(table(spark, sf_dir, "orders"))


def julian(rows):
    d = F.col("o_orderdate")
    return rows.select("o_orderkey", dates.julian_day(F.year(d), F.month(d), F.day(d)).cast("double").alias("jd"))


@query("""
    SELECT event_type, (props::JSON->>'k')::INTEGER AS k, count(*) AS n FROM events GROUP BY ALL
""")
def json_property_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""
    SELECT lang FROM documents WHERE n_chars > 5000 INTERSECT SELECT lang FROM documents WHERE n_chars < 200
""")
def set_operations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter("n_chars > 5000").select("lang").intersect(d.filter("n_chars < 200").select("lang"))


@query("""
    SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS r2 FROM lineitem
""")
def linear_fit_price(spark, sf_dir):
    out = fit.linear_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", r6("slope", 4).alias("slope"), r6("intercept", 3).alias("intercept"), r6("r2").alias("r2"))


@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) + 0.0 AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 AS sum_disc, round(avg(l_discount), 6) + 0.0 AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), r6(F.sum("l_extendedprice"), 2).alias("sum_base"), r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), r6(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n")
    )


@query()
def quality_classifiers(spark, sf_dir):
    """Cross-validated accuracy of two classifiers on simple text features."""
    from structlab.functions.text import printable_ratio

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select(
        "quality", F.length("text").cast("double").alias("chars"), printable_ratio(F.col("text")).alias("printable"),
        (F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.length("text")).alias("upper"), (F.length(F.regexp_replace("text", "[A-Za-z\\s]", "")) / F.length("text")).alias("signs"),
    )
    checkpoints(spark)
    return fit.train_classifiers(rows, ["chars", "printable", "upper", "signs"], "quality", 3)


def _stream(spark, sf_dir, shape, name, mode="complete"):
    import uuid

    from structlab.streaming import events as st

    events = st.event_stream(spark, f"{sf_dir}/events.parquet")
    return st.run_to_table(shape(events), f"{name}_{uuid.uuid4().hex[:8]}", mode, shared_dir(spark, "stream"))


@query("""
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL
""")
def stream_tumbling(spark, sf_dir):
    from structlab.streaming import events as st

    out = _stream(spark, sf_dir, lambda e: st.tumbling(e, "1 day"), "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total", 4).alias("total"))


@query("""
    WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR, true)::INT AS new FROM events),
         s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_session(spark, sf_dir):
    from structlab.streaming import events as st

    out = _stream(spark, sf_dir, lambda e: st.sessions(e, "12 hours"), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_deduplicated(spark, sf_dir):
    from structlab.streaming import events as st

    # The rows are as many as the events: they go to a table, not to the driver's memory.
    rows = st.deduplicated(st.event_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts"), "1000 days")
    out = st.run_to_parquet(rows, shared_dir(spark, "dedup"), shared_dir(spark, "stream"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
    WITH k AS (SELECT DISTINCT p_brand AS brand, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part), c AS (SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS core FROM customer)
    SELECT brand, count(*) AS n_customers, min(c_custkey) AS first_key FROM c JOIN k ON digits <> '' AND contains(core, digits) GROUP BY brand
""")
def digit_containment(spark, sf_dir):
    """Customers whose name holds a brand's digits, by equality of substrings."""
    only = lambda c: F.regexp_replace(c, "[^0-9]", "")
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), only("p_brand").alias("digits")).distinct()
    customers = table(spark, sf_dir, "customer").select("c_custkey", only("c_name").alias("core"))
    return joins.containment_join(customers, brands, "core", "digits").groupBy("brand").agg(F.count("*").alias("n_customers"), F.min("c_custkey").alias("first_key"))
