"""Points, spheres, grids and fits over positions derived from keys by hash."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from structlab.functions import sphere
from structlab.functions.rng import uniform
from structlab.operators import fit, graph, grid, joins, nulls, spatial, tolerance
from structlab.plans.registry import micros, query, r6, sql_uniform, table

LAT, LON = sql_uniform("'site'", "c_custkey::VARCHAR"), sql_uniform("'site'", "c_custkey::VARCHAR", lane=1)
SITES = f"""s AS (SELECT c_custkey AS id, c_nationkey AS nation, -60 + 120 * {LAT} AS lat, -180 + 360 * {LON} AS lon FROM customer)"""


def sites(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    u, v = uniform("site", F.col("c_custkey")), uniform("site", F.col("c_custkey"), lane=1)
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (-60.0 + 120.0 * u).alias("lat"), (-180.0 + 360.0 * v).alias("lon"))


def sql_sep(a: str, b: str) -> str:
    """Angle in degrees by the haversine between aliases with lat and lon."""
    return f"degrees(2 * asin(sqrt(least(1, power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"


@query(f"""
    WITH {SITES}, m(name, lat, lon) AS (VALUES ('giza', 29.9792, 31.1342), ('stonehenge', 51.1789, -1.8262), ('nazca', -14.739, -75.13), ('angkor', 13.4125, 103.867)),
         d AS (SELECT s.id, m.name, {sql_sep("s", "m")} AS d FROM s, m)
    SELECT id, arg_min(name, (d, name)) AS name, round(radians(min(d)) * {sphere.EARTH_KM}, 4) + 0.0 AS km FROM d GROUP BY id
""")
def nearest_dimension(spark, sf_dir):
    """Nearest of a few landmarks (fixed values: their coordinates)."""
    marks = [("giza", 29.9792, 31.1342), ("stonehenge", 51.1789, -1.8262), ("nazca", -14.739, -75.13), ("angkor", 13.4125, 103.867)]
    dim = spark.createDataFrame(marks, "name string, mlat double, mlon double")
    km = sphere.haversine_km(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon"))
    out = joins.nearest_dimension(sites(spark, sf_dir), dim, km, ["id"], ["name"], "name")
    return out.select("id", "name", r6("distance", 4).alias("km"))


@query(f"""
    WITH {SITES}, t AS (SELECT * FROM s), d AS (SELECT a.id, {sql_sep("a", "b")} AS d FROM t a JOIN t b ON a.id <> b.id AND a.nation = b.nation)
    SELECT id, round(min(d), 6) + 0.0 AS nn_deg FROM d GROUP BY id
""")
def haversine_nn(spark, sf_dir):
    """Nearest neighbour within each nation; cells are as wide as about five sites of the largest nation need."""
    p = sites(spark, sf_dir)
    most = p.groupBy("nation").count().agg(F.max("count")).first()[0] or 1
    out = spatial.sky_nearest(p, "id", "lon", "lat", min(60.0, math.degrees(2.0 * math.sqrt(5.0 / most))), ["nation"])
    return out.select("id", r6("nn").alias("nn_deg"))


X, Y = sql_uniform("'xy'", "s_suppkey::VARCHAR"), sql_uniform("'xy'", "s_suppkey::VARCHAR", lane=1)
PLANE = f"p AS (SELECT s_suppkey AS id, 1000 * {X} AS x, 1000 * {Y} AS y FROM supplier)"


def plane(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (1000.0 * uniform("xy", F.col("s_suppkey"))).alias("x"), (1000.0 * uniform("xy", F.col("s_suppkey"), lane=1)).alias("y"))


D = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"


@query(f"WITH {PLANE} SELECT a.id AS a, b.id AS b, round({D}, 6) + 0.0 AS d FROM p a JOIN p b ON a.id < b.id AND {D} <= 120")
def close_pairs(spark, sf_dir):
    return spatial.close_pairs(plane(spark, sf_dir), "id", "x", "y", 120.0, fine=4).select("a", "b", r6("d").alias("d"))


@query(f"""
    WITH {PLANE}, k AS (SELECT r, 2 * count(*) AS k FROM (SELECT unnest([50.0::DOUBLE, 100.0, 200.0]) AS r), p a JOIN p b ON a.id < b.id AND {D} <= r GROUP BY r), n AS (SELECT count(*) AS n FROM p)
    SELECT r, k::BIGINT AS k_count, round(sqrt(1e6 * k / (n * n) / pi()) - r, 6) + 0.0 AS l_minus_r FROM k, n
""")
def ripley_k(spark, sf_dir):
    out = spatial.ripley(plane(spark, sf_dir), "id", "x", "y", [50.0, 100.0, 200.0], 1e6)
    return out.filter("k_count > 0").select("r", F.col("k_count").cast("long").alias("k_count"), r6("l_minus_r").alias("l_minus_r"))


@query(f"""
    WITH {PLANE}, nn AS (SELECT a.id, min({D}) AS nn FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id), n AS (SELECT count(*) AS n, avg(nn) AS m FROM nn)
    SELECT n, round(m, 6) + 0.0 AS mean_nn, round(m / (0.5 / sqrt(n / 1e6)), 6) + 0.0 AS R, round((m - 0.5 / sqrt(n / 1e6)) / (0.26136 / sqrt(n * (n / 1e6))), 6) + 0.0 AS z FROM n
""")
def clark_evans(spark, sf_dir):
    nn = spatial.nearest_neighbours(plane(spark, sf_dir), "id", "x", "y", 60.0)
    return spatial.clark_evans(nn, 1e6).select("n", r6("mean_nn").alias("mean_nn"), r6("R").alias("R"), r6("z").alias("z"))


CSR_X, CSR_Y = sql_uniform("'csr'", "t::VARCHAR", "i::VARCHAR"), sql_uniform("'csr'", "t::VARCHAR", "i::VARCHAR", lane=1)


@query(f"""
    WITH {PLANE}, q AS (SELECT t, i AS id, 1000 * {CSR_X} AS x, 1000 * {CSR_Y} AS y FROM (SELECT unnest(range(0, 10)) AS t), (SELECT unnest(range(0, 100)) AS i)),
         o AS (SELECT avg(nn) AS o FROM (SELECT a.id, min({D}) AS nn FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id)),
         s AS (SELECT t, avg(nn) AS m FROM (SELECT a.t, a.id, min({D}) AS nn FROM q a JOIN q b ON a.t = b.t AND a.id <> b.id GROUP BY ALL) GROUP BY t)
    SELECT round(o, 6) + 0.0 AS observed, count(*) AS n_trials, round(avg(m), 6) + 0.0 AS null_mean, round(stddev_samp(m), 6) + 0.0 AS null_sd, round((o - avg(m)) / stddev_samp(m), 4) + 0.0 AS z FROM s, o GROUP BY o
""")
def clark_evans_null(spark, sf_dir):
    """Mean nearest distance against ten simulations of a hundred uniform points."""
    observed = spatial.nearest_neighbours(plane(spark, sf_dir), "id", "x", "y", 60.0).agg(F.avg("nn").alias("m"))
    sims = nulls.uniform_points(100, 10, (0.0, 1000.0, 0.0, 1000.0), "csr", spark)
    null = spatial.nearest_neighbours(sims, "i", "x", "y", 60.0, ["trial"]).groupBy("trial").agg(F.avg("nn").alias("m"))
    out = nulls.summarize(observed, null, "m", ddof=1)
    return out.select("n_trials", *[r6(c).alias(c) for c in ("observed", "null_mean", "null_sd")], r6("z", 4).alias("z"))


@query(f"""
    WITH {SITES}, t AS (SELECT * FROM s), d AS (SELECT a.id AS a, b.id AS b, {sql_sep("a", "b")} AS d FROM t a JOIN t b ON a.id < b.id)
    SELECT a, b, round(d, 6) + 0.0 AS sep FROM d WHERE d <= 2
""")
def sky_close_pairs(spark, sf_dir):
    return close_sites(sites(spark, sf_dir))


def close_sites(p):
    return spatial.sky_neighbours(p, "id", "lon", "lat", 2.0).select("a", "b", r6("sep").alias("sep"))


BEAR = """CASE WHEN true THEN (degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360 END"""


def fold_sql(a: str, b: str) -> str:
    d = f"least(abs({a} - {b}), 360 - abs({a} - {b}))"
    return f"least({d}, abs(180 - {d}))"


@query(f"""
    WITH {SITES}, t AS (SELECT * FROM s), p AS (SELECT a.nation AS g, a.id AS i, b.id AS j, {BEAR} AS b FROM t a JOIN t b ON a.nation = b.nation AND a.id < b.id),
         v AS (SELECT x.g, least({fold_sql("x.b", "y.b")}, {fold_sql("x.b", "z.b")}, {fold_sql("y.b", "z.b")}) AS dev
               FROM p x JOIN p y ON x.g = y.g AND x.i = y.i AND x.j < y.j JOIN p z ON z.g = x.g AND z.i = x.j AND z.j = y.j)
    SELECT tol, count(*) FILTER (dev <= tol) AS n_triples, round(avg(dev), 6) + 0.0 AS mean_dev FROM v, (SELECT unnest([0.5::DOUBLE, 1.0, 2.0, 5.0]) AS tol) GROUP BY tol
""")
def collinear_triples(spark, sf_dir):
    rows = sites(spark, sf_dir)
    return over_nations(spatial.collinear_triples_whole(rows, "id", "lat", "lon", [0.5, 1.0, 2.0, 5.0], ["nation"]), rows)


def over_nations(out, rows):
    n = F.sum("n_triples")
    per = out.join(rows.groupBy("nation").count().select("nation", (F.col("count") * (F.col("count") - 1) * (F.col("count") - 2) / 6).alias("w")), "nation")
    return per.groupBy("tol").agg(n.alias("n_triples"), r6(F.sum(F.col("mean_dev") * F.col("w")) / F.sum("w")).alias("mean_dev"))


GX = "sin(radians(lat)) * sin(radians(d0)) + cos(radians(lat)) * cos(radians(d0)) * cos(radians(lon) - radians(a0))"


@query(f"""
    WITH {SITES}, v AS (SELECT s.*, c_acctbal / 1000 AS v, power(1 + (id % 3), -2)::DOUBLE AS w FROM s JOIN customer ON c_custkey = id),
         g AS (SELECT 360.0::DOUBLE * (i + 0.5) / 8 AS a0, -90.0::DOUBLE + 180.0 * (j + 0.5) / 4 AS d0 FROM (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 4)) AS j)),
         x AS (SELECT a0, d0, v, w, {GX} AS x FROM v, g),
         q AS (SELECT a0, d0, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * v) AS sy, sum(w * x * x) AS sxx, sum(w * x * v) AS sxy, sum(w * v * v) AS syy FROM x GROUP BY ALL)
    SELECT a0 AS ra0, d0 AS dec0, n, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 6) + 0.0 AS amplitude,
           round((sw * sxy - sx * sy) / sqrt((sw * sxx - sx * sx) * (sw * syy - sy * sy)), 6) + 0.0 AS r FROM q
""")
def dipole_grid_fit(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("v"))
    rows = sites(spark, sf_dir).join(c, "id").withColumn("e", (1 + F.col("id") % 3).cast("double"))
    out = fit.dipole_grid(rows, "lon", "lat", "v", "e", 8, 4)
    return out.select("ra0", "dec0", "n", r6("amplitude").alias("amplitude"), r6("r").alias("r"))


@query(f"""
    WITH {SITES}, r AS (SELECT id, lon AS ra, lat AS dec FROM s),
         g AS (SELECT id, asin(least(1, greatest(-1, sin(radians(dec)) * sin(radians(27.12825)) + cos(radians(dec)) * cos(radians(27.12825)) * cos(radians(ra - 192.85948))))) AS b FROM r)
    SELECT count(*) AS n, round(avg(abs(degrees(b))), 6) + 0.0 AS mean_abs_b, round(avg((abs(degrees(b)) < 20)::INT), 6) + 0.0 AS below_20, round(avg((abs(degrees(b)) < 5)::INT), 6) + 0.0 AS below_5 FROM g
""")
def galactic_latitude_stats(spark, sf_dir):
    b = F.abs(sphere.galactic(F.col("lon"), F.col("lat"))["b"])
    return sites(spark, sf_dir).select(b.alias("b")).agg(
        F.count("*").alias("n"), r6(F.avg("b")).alias("mean_abs_b"), r6(F.avg((F.col("b") < 20).cast("int"))).alias("below_20"), r6(F.avg((F.col("b") < 5).cast("int"))).alias("below_5")
    )


@query(f"""
    WITH {SITES}, o AS (SELECT nation, lat, dayofyear(o_orderdate) AS doy FROM orders JOIN s ON id = o_custkey), c AS (SELECT nation, doy, lat, 23.44 * sin(radians(360 / 365.25::DOUBLE * (doy - 80))) AS dec FROM o),
         a AS (SELECT nation, sin(radians(dec)) / cos(radians(lat)) AS x FROM c)
    SELECT nation, count(*) AS n, round(avg(degrees(acos(x))), 5) + 0.0 AS mean_azimuth, round(min(degrees(acos(x))), 6) + 0.0 AS northmost, round(max(degrees(acos(x))), 6) + 0.0 AS southmost FROM a WHERE abs(x) <= 1 GROUP BY nation
""")
def sunrise_azimuths(spark, sf_dir):
    """Where the sun rises at each customer's site on the days of their orders, by nation."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.dayofyear("o_orderdate").alias("doy"))
    at = sites(spark, sf_dir).join(o, "id")
    rows = at.select("nation", sphere.rising_azimuth(F.col("lat"), sphere.solar_declination(F.col("doy"))).alias("az")).filter("az is not null")
    return rows.groupBy("nation").agg(F.count("*").alias("n"), r6(F.avg("az"), 5).alias("mean_azimuth"), r6(F.min("az")).alias("northmost"), r6(F.max("az")).alias("southmost"))


#: Per event type a grid of hours by days: how many events fell into each cell, and whether that is odd.
GRID = """e AS (SELECT event_type AS grid, epoch_us(ts) // 3600000000 AS t FROM events WHERE ts IS NOT NULL), d AS (SELECT min(t // 24) AS first, max(t // 24) - min(t // 24) + 1 AS w FROM e),
         n AS (SELECT grid, t % 24 AS r, t // 24 - first AS c, count(*) AS n FROM e, d GROUP BY ALL),
         g AS (SELECT k.grid, h.r, y.c, coalesce(n, 0) AS n, (coalesce(n, 0) % 2)::INT AS v, 24 AS h, w
               FROM (SELECT DISTINCT grid FROM e) k CROSS JOIN (SELECT unnest(range(0, 24)) AS r) h CROSS JOIN (SELECT unnest(range(0, w)) AS c, w FROM d) y LEFT JOIN n ON n.grid = k.grid AND n.r = h.r AND n.c = y.c)"""


def hour_grid(spark, sf_dir):
    """(grid, r, c, n, v) of every hour of every day of each event type."""
    e = table(spark, sf_dir, "events").filter("ts is not null").select(F.col("event_type").alias("grid"), F.floor(micros("ts") / 3_600_000_000).alias("t"))
    day = F.floor(F.col("t") / 24)
    days = e.agg(F.min(day).alias("first"), (F.max(day) - F.min(day) + 1).alias("w"))  # one row
    n = e.crossJoin(F.broadcast(days)).groupBy("grid", (F.col("t") % 24).alias("r"), (day - F.col("first")).alias("c")).agg(F.count("*").alias("n"))
    every = e.select("grid").distinct().crossJoin(F.broadcast(days))
    every = every.select("grid", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("c")).select("grid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("r"), "c")
    return every.join(n, ["grid", "r", "c"], "left").select("grid", "r", "c", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) % 2).cast("int").alias("v"))


@query(f"""
    WITH {GRID}, n2 AS (SELECT a.grid, (a.v = b.v)::INT AS s FROM g a JOIN g b ON a.grid = b.grid AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c)))
    SELECT grid, round(avg(s), 6) + 0.0 AS agreement FROM n2 GROUP BY grid
""")
def neighbour_agreement(spark, sf_dir):
    return grid.neighbour_agreement(hour_grid(spark, sf_dir), ["grid"]).select("grid", r6("agreement").alias("agreement"))


@query(f"""
    WITH {GRID}, i AS (SELECT grid, v, 'horizontal' AS kind, r AS r2, w - 1 - c AS c2 FROM g UNION ALL SELECT grid, v, 'vertical', h - 1 - r, c FROM g UNION ALL SELECT grid, v, 'half_turn', h - 1 - r, w - 1 - c FROM g)
    SELECT i.grid, kind, round(avg((i.v = g.v)::INT), 6) + 0.0 AS agreement FROM i JOIN g ON g.grid = i.grid AND g.r = r2 AND g.c = c2 GROUP BY ALL
""")
def grid_symmetry(spark, sf_dir):
    return grid.symmetry(hour_grid(spark, sf_dir), ["grid"]).select("grid", "kind", r6("agreement").alias("agreement"))


@query(f"""
    WITH {GRID}, b AS (SELECT DISTINCT grid, s, r // s AS br, c // s AS bc FROM g, (SELECT unnest([1, 2, 4, 8]) AS s) WHERE v = 1), m AS (SELECT grid, s, count(*) AS n FROM b GROUP BY ALL)
    SELECT grid, round(regr_slope(ln(n), ln(1 / s)), 6) + 0.0 AS dimension, round(regr_r2(ln(n), ln(1 / s)), 6) + 0.0 AS r2 FROM m GROUP BY grid
""")
def box_dimension(spark, sf_dir):
    out = grid.fractal_dimension(grid.box_counts(hour_grid(spark, sf_dir), ["grid"], [1, 2, 4, 8]), ["grid"])
    return out.select("grid", r6("dimension").alias("dimension"), r6("r2").alias("r2"))


@query(f"""
    WITH {GRID}, a AS (SELECT *, sum(v) OVER (PARTITION BY grid, r ORDER BY c ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS x FROM g), m AS (SELECT *, sum(x) OVER (PARTITION BY grid, c ORDER BY r ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM a)
    SELECT grid, round(var_pop(m) / power(avg(m), 2) + 1, 6) + 0.0 AS lacunarity FROM m WHERE r <= h - 3 AND c <= w - 3 GROUP BY grid
""")
def lacunarity(spark, sf_dir):
    return grid.lacunarity(hour_grid(spark, sf_dir), ["grid"], 3).select("grid", r6("lacunarity").alias("lacunarity"))


@query(f"""
    WITH {GRID} SELECT grid, string_agg(v::VARCHAR, '' ORDER BY r, CASE WHEN r % 2 = 0 THEN c ELSE -c END) AS bits FROM g GROUP BY grid
""")
def reading_order(spark, sf_dir):
    return grid.flatten_grid(hour_grid(spark, sf_dir), ["grid"], "boustrophedon")


@query(f"""
    WITH {GRID}, k AS (SELECT *, least(r, c, h - 1 - r, w - 1 - c) AS ring FROM g), s AS (SELECT *, CASE WHEN r = ring THEN 0 WHEN c = w - 1 - ring THEN 1 WHEN r = h - 1 - ring THEN 2 ELSE 3 END AS side FROM k)
    SELECT grid, string_agg(v::VARCHAR, '' ORDER BY ring, side, CASE side WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN -c ELSE -r END) AS bits FROM s GROUP BY grid
""")
def spiral_reading(spark, sf_dir):
    return grid.flatten_grid(hour_grid(spark, sf_dir), ["grid"], "spiral_cw")


@query()
def fft_peakiness(spark, sf_dir):
    counts = hour_grid(spark, sf_dir).select("grid", "r", "c", F.col("n").alias("v"))
    return grid.fft_peakiness(counts, ["grid"])


@query("""
    WITH d AS (SELECT s_suppkey AS k, (s_acctbal + 1000) / 100 AS v FROM supplier), p AS (SELECT a.k AS a, b.k AS b, greatest(a.v, b.v) / least(a.v, b.v) AS r FROM d a JOIN d b ON a.k < b.k),
         f AS (SELECT a, b, r / power(2, floor(log2(r))) AS f FROM p), n(place, note, v) AS (VALUES (0, 'unison', 1::DOUBLE), (1, 'second', 9 / 8), (2, 'third', 5 / 4), (3, 'fourth', 4 / 3), (4, 'fifth', 3 / 2), (5, 'sixth', 5 / 3), (6, 'seventh', 15 / 8), (7, 'octave', 2)),
         c AS (SELECT a, b, arg_min(note, (round(abs(1200 * log2(f / v)), 6), place)) AS note, round(min(abs(1200 * log2(f / v))), 4) + 0.0 AS off FROM f, n GROUP BY ALL)
    SELECT note, count(*) AS n_pairs, count(*) FILTER (off <= 20) AS n_hits FROM c GROUP BY note
""")
def pairwise_ratio_diatonic(spark, sf_dir):
    """Ratios of all pairs of the table against the just scale."""
    return diatonic_hits(table(spark, sf_dir, "supplier"))


def diatonic_hits(supplier):
    v = supplier.select(F.lit(0).alias("g"), ((F.col("s_acctbal") + 1000) / 100).alias("v")).withColumn("y", F.log2("v")).filter("y is not null")
    return tolerance.note_shares(v, ["g"], "y", 20.00005, "v").filter("n_pairs > 0").select("note", "n_pairs", "n_hits")


@query(f"""
    WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS v FROM events WHERE value IS NOT NULL),
         s AS (SELECT user_id, i, v FROM e WHERE i <= 6), g AS (SELECT unnest(range(1, 7)) * 1.0::DOUBLE AS mu), h AS (SELECT unnest([0.5::DOUBLE, 1.0, 2.0]) AS sg),
         f AS (SELECT user_id, mu, sg, v, exp(-0.5::DOUBLE * power((i - mu) / sg, 2)) AS f FROM s, g, h), q AS (SELECT user_id, mu, sg, sum(f * v) AS fv, sum(f * f) AS ff, sum(v * v) AS vv FROM f GROUP BY ALL)
    SELECT user_id, round(min(vv - fv * fv / ff), 4) + 0.0 AS rss FROM q GROUP BY user_id
""")
def beam_transit_fit(spark, sf_dir):
    return beam_fit(table(spark, sf_dir, "events"))


def beam_fit(events):
    from pyspark.sql import Window

    rows = events.filter("value is not null").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"), F.col("value").alias("v")).filter("i <= 6")
    out = fit.beam_grid(rows, "i", "v", "gaussian", [float(k) for k in range(1, 7)], [0.5, 1.0, 2.0], ["user_id"])
    return fit.best_beam(out, ["user_id"]).select("user_id", r6("rss", 4).alias("rss"))


@query()
def convex_hulls(spark, sf_dir):
    return spatial.convex_hull_area(sites(spark, sf_dir), "lon", "lat", ["nation"])


@query()
def hull_envelope(spark, sf_dir):
    """L(r) - r of the sites of suppliers against nine sets of uniform points within their hull."""
    out = spatial.hull_envelope(plane(spark, sf_dir), "id", "x", "y", 9, "hull")
    return out.select(*[r6(c).alias(c) for c in ("r", "observed", "null_mean", "z")], "outside", r6("nn_ratio").alias("nn_ratio"), r6("nn_z").alias("nn_z"))


@query()
def spanning_trees(spark, sf_dir):
    pairs = spatial.linking_pairs(sites(spark, sf_dir), "id", "lon", "lat", 25.0, ["nation"])
    return graph.spanning_tree(pairs, "nation")


@query(f"""
    WITH RECURSIVE {PLANE}, e AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.id <> b.id AND {D} <= 90),
         w AS (SELECT x AS node, x AS seen FROM e UNION SELECT w.node, e.y FROM w JOIN e ON e.x = w.seen)
    SELECT node, min(seen) AS component FROM w GROUP BY node
""")
def connected_components(spark, sf_dir):
    """Components of points linked within a distance (density clustering with one neighbour)."""
    pairs = spatial.linking_pairs(plane(spark, sf_dir), "id", "x", "y", 90.0).select(F.col("a").alias("x"), F.col("b").alias("y"))
    return graph.connected_components(pairs)


@query(f"SELECT round(avg((1 - cos(2 * pi() * {sql_uniform("'mc'", 'o_orderkey::VARCHAR')})) / 2), 6) + 0.0 AS mean, count(*) AS n FROM orders")
def monte_carlo_illumination(spark, sf_dir):
    """Mean illumination if each order fell on a random phase."""
    x = (1.0 - F.cos(2.0 * math.pi * uniform("mc", F.col("o_orderkey")))) / 2.0
    return table(spark, sf_dir, "orders").agg(r6(F.avg(x)).alias("mean"), F.count("*").alias("n"))
