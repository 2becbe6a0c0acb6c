"""Rasters binned from tables: components, filters over neighbourhoods and sampled means, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from structlab.functions import text
from structlab.operators import hough, raster, spiral
from structlab.plans.registry import micros, query, r6, table

#: Side of the tiles of these queries: small, so that what is found crosses tiles.
TILE = 32


def event_cells(spark, sf_dir):
    """Per event type a raster of days by ten-minute slots; a cell is set where an event fell into it."""
    minute = F.floor(micros("ts") / 60_000_000)
    first = F.floor(minute / 1440)
    e = table(spark, sf_dir, "events").filter("ts is not null").select(F.col("event_type").alias("kind"), first.alias("day"), F.floor((minute % 1440) / 10).alias("c"))
    start = e.agg(F.min("day").alias("start"))  # one row
    cells = e.crossJoin(F.broadcast(start)).select("kind", (F.col("day") - F.col("start")).alias("r"), "c")
    return cells.groupBy("kind", "r", "c").agg(F.count("*").alias("v"))


_SLOTS = """m AS (SELECT event_type AS kind, epoch_us(ts) // 60000000 AS minute FROM events WHERE ts IS NOT NULL),
         q AS (SELECT DISTINCT kind, minute // 1440 - (SELECT min(minute // 1440) FROM m) AS r, minute % 1440 // 10 AS c FROM m)"""


@query(f"""
    WITH RECURSIVE {_SLOTS},
         w AS (SELECT kind, r, c, r AS r2, c AS c2 FROM q UNION SELECT w.kind, w.r, w.c, q.r, q.c FROM w JOIN q ON q.kind = w.kind AND q.r BETWEEN w.r2 - 1 AND w.r2 + 1 AND q.c BETWEEN w.c2 - 1 AND w.c2 + 1),
         l AS (SELECT kind, r, c, min(r2 * 4294967296 + c2) AS label FROM w GROUP BY ALL),
         s AS (SELECT kind, label, count(*) AS area, greatest(max(r) - min(r), max(c) - min(c)) + 1 AS side FROM l GROUP BY ALL)
    SELECT kind, count(*) AS n_components, max(area) AS largest, round(coalesce(max(side / sqrt(area)) FILTER (area >= 3), 0), 6) + 0.0 AS score, sum(label % 1000003)::BIGINT AS label_sum FROM s GROUP BY kind
""")
def mask_components(spark, sf_dir):
    """8-connected components of the event rasters and their elongation."""
    labels = raster.components8(event_cells(spark, sf_dir), ["kind"], TILE)
    shapes = raster.component_shapes(labels, ["kind"])
    sums = shapes.groupBy("kind").agg(F.sum(F.col("label") % 1000003).alias("label_sum"))
    out = raster.elongation_score(shapes, ["kind"], 3).join(sums, "kind")
    return out.select("kind", "n_components", "largest", r6("score").alias("score"), "label_sum")


def ship_raster(spark, sf_dir):
    """Per return flag the lines by day of shipping (from 1992) and quantity."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.datediff("l_shipdate", F.lit("1992-01-01")).alias("r"), (F.col("l_quantity") - 1).cast("int").alias("c"))
    return rows.filter("r >= 0 and c >= 0").groupBy(F.col("l_returnflag").alias("flag"), "r", "c").agg(F.count("*").alias("v"))


_SHIPS = """n AS (SELECT l_returnflag AS flag, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS r, l_quantity::INT - 1 AS c, count(*) AS v FROM lineitem GROUP BY ALL HAVING r >= 0 AND c >= 0),
         z AS (SELECT flag, max(r) + 1 AS h, max(c) + 1 AS w FROM n GROUP BY flag),
         g AS (SELECT a.flag, a.r, a.c, a.h, a.w, coalesce(v, 0) AS v FROM (SELECT flag, unnest(range(0, h)) AS r, c, h, w FROM (SELECT flag, h, w, unnest(range(0, w)) AS c FROM z)) a LEFT JOIN n ON n.flag = a.flag AND n.r = a.r AND n.c = a.c)"""


def _sql_extreme(name: str, source: str, agg: str) -> str:
    """Extreme over a disc of radius 1: the cell and its four neighbours."""
    near = " UNION ALL ".join(f"SELECT flag, r + {a} AS r, c + {b} AS c, v FROM {source}" for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))
    return f"{name} AS (SELECT flag, r, c, {agg}(v) AS v FROM ({near}) JOIN z USING (flag) WHERE r >= 0 AND c >= 0 AND r < h AND c < w GROUP BY ALL)"


@query(f"""
    WITH {_SHIPS}, {_sql_extreme("e1", "g", "min")}, {_sql_extreme("o", "e1", "max")}, {_sql_extreme("d1", "o", "max")}, {_sql_extreme("x", "d1", "min")}
    SELECT flag, c, count(*) AS n, sum(o.v)::BIGINT AS opened, sum(x.v)::BIGINT AS closed, sum(x.v * (x.r % 97))::BIGINT AS weighted FROM o JOIN x USING (flag, r, c) GROUP BY ALL
""")
def raster_open_close(spark, sf_dir):
    """Opening, then closing of the shipping rasters by a disc of radius 1; sums per column."""
    opened = raster.morph_open(ship_raster(spark, sf_dir), ["flag"], 1, TILE)
    closed = raster.morph_close(opened, ["flag"], 1, TILE)
    both = opened.withColumnRenamed("v", "o").join(closed, ["flag", "r", "c"])
    return both.groupBy("flag", "c").agg(
        F.count("*").alias("n"), F.sum("o").cast("long").alias("opened"), F.sum("v").cast("long").alias("closed"), F.sum(F.col("v") * (F.col("r") % 97)).cast("long").alias("weighted")
    )


def _sql_replicated(value: str, axis: str, other: str, side: str) -> str:
    """Sum over two cells on either side along an axis, the edge cells standing for those outside."""
    whole = f"OVER (PARTITION BY flag, {other} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    near = f"sum({value}) OVER (PARTITION BY flag, {other} ORDER BY {axis} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    return f"{near} + greatest(2 - {axis}, 0) * first_value({value}) {whole} + greatest({axis} + 3 - {side}, 0) * last_value({value}) {whole}"


@query(f"""
    WITH {_SHIPS}, a AS (SELECT *, {_sql_replicated("v", "c", "r", "w")} AS across FROM g), s AS (SELECT *, {_sql_replicated("across", "r", "c", "h")} AS total FROM a)
    SELECT flag, c, count(*) AS n, count(*) FILTER (v > total / 25 - 0.25) AS n_set, sum(r % 97) FILTER (v > total / 25 - 0.25)::BIGINT AS weighted FROM s GROUP BY ALL
""")
def raster_adaptive(spark, sf_dir):
    """Cells of the shipping rasters above the mean of their 5 by 5 window less a quarter."""
    mask = raster.adaptive_threshold(ship_raster(spark, sf_dir), ["flag"], 5, 0.25, "mean", TILE)
    return mask.groupBy("flag", "c").agg(F.count("*").alias("n"), F.count_if(F.col("v") == 1).alias("n_set"), F.sum(F.when(F.col("v") == 1, F.col("r") % 97)).alias("weighted"))


_LAG = lambda v, axis, other, first, then: f"coalesce({first}({v}) OVER (PARTITION BY flag, {other} ORDER BY {axis}), {then}({v}) OVER (PARTITION BY flag, {other} ORDER BY {axis}))"
_STEP = lambda v, axis, other: f"({_LAG(v, axis, other, 'lead', 'lag')} - {_LAG(v, axis, other, 'lag', 'lead')})"
_SUM3 = lambda v, axis, other: f"({_LAG(v, axis, other, 'lead', 'lag')} + 2 * {v} + {_LAG(v, axis, other, 'lag', 'lead')})"


@query(f"""
    WITH {_SHIPS}, a AS (SELECT *, {_STEP("v", "c", "r")} AS x1, {_STEP("v", "r", "c")} AS y1 FROM g),
         s AS (SELECT flag, r, c, {_SUM3("x1", "r", "c")}::DOUBLE AS gx, {_SUM3("y1", "c", "r")}::DOUBLE AS gy FROM a),
         p AS (SELECT s.*, c - w / 2.0::DOUBLE AS dx, r - h / 2.0::DOUBLE AS dy, sqrt(gx * gx + gy * gy) + 1e-6::DOUBLE AS mag FROM s JOIN z USING (flag)),
         t AS (SELECT flag, quantile_cont(mag, 0.6) AS least, max(sqrt(dx * dx + dy * dy)) AS reach FROM p GROUP BY flag),
         u AS (SELECT flag, floor(sqrt(dx * dx + dy * dy) / (reach + 1e-6::DOUBLE) * 4)::INT AS ring, (gy * dx - gx * dy) / (sqrt(dx * dx + dy * dy) + 1e-6::DOUBLE) AS along, mag FROM p JOIN t USING (flag) WHERE mag > least)
    SELECT flag, ring, count(*) AS n, round(sum(along * mag) / sum(mag), 6) + 0.0 AS mean_tangential, CASE WHEN sum(along * mag) > 0 THEN 'ccw' ELSE 'cw' END AS sense FROM u GROUP BY ALL
""")
def swirl_rings(spark, sf_dir):
    """Gradients along circles about the centre of each shipping raster, by ring."""
    out = raster.swirl(ship_raster(spark, sf_dir), ["flag"], tile=TILE)
    return out.select("flag", "ring", "n", r6("mean_tangential").alias("mean_tangential"), "sense")


@query(f"""
    WITH {_SHIPS}, a AS (SELECT *, sum(v) OVER (PARTITION BY flag, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS across FROM g),
         s AS (SELECT *, sum(across) OVER (PARTITION BY flag, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)::DOUBLE / ((least(r + 2, h - 1) - greatest(r - 2, 0) + 1) * (least(c + 2, w - 1) - greatest(c - 2, 0) + 1)) AS mean FROM a)
    SELECT flag, c, count(*) AS n, round(sum(mean), 4) + 0.0 AS means FROM s GROUP BY ALL
""")
def window_means(spark, sf_dir):
    """Means of 5 by 5 windows about every cell of the shipping rasters, cut at the edges: four sums each."""
    cells = ship_raster(spark, sf_dir)
    size = raster.extents(cells, ["flag"])
    sums = raster.summed_area(cells, ["flag"], TILE)
    out = raster.window_means(sums.select("flag", "r", "c"), sums, size, ["flag"], 2)
    return out.groupBy("flag", "c").agg(F.count("*").alias("n"), r6(F.sum("mean"), 4).alias("means"))


SWEEP_TURNS, SWEEP_STEPS = (8, 12, 16), 4


@query(f"""
    WITH p AS (SELECT date_diff('day', DATE '1992-01-01', l_shipdate::DATE) // 40 AS r, floor(l_extendedprice / 1100)::BIGINT AS c, least(255, count(*) * 20) AS v FROM lineitem GROUP BY 1, 2 HAVING r >= 0 AND c >= 0),
         z AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM p), n AS (SELECT 8 * max(length(r_name)) AS n FROM region),
         k AS (SELECT r_name AS name, bit, (ascii(substr(r_name, (bit // 8 + 1)::INT, 1)) >> (7 - bit % 8)::INT) & 1 AS on_ FROM (SELECT r_name, unnest(range(0, 8 * length(r_name))) AS bit FROM region)),
         g AS (SELECT (((t * 3 + i) * 2 + o) * 2 + d) * {SWEEP_STEPS} + s AS cfg, {list(map(float, SWEEP_TURNS))}[t + 1]::DOUBLE AS turns, [0.08, 0.12, 0.18][i + 1]::DOUBLE AS inner_, o, d, 2 * pi() * s / {SWEEP_STEPS} AS theta
               FROM (SELECT unnest(range(0, {len(SWEEP_TURNS)})) AS t), (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 2)) AS o), (SELECT unnest(range(0, 2)) AS d), (SELECT unnest(range(0, {SWEEP_STEPS})) AS s)),
         b AS (SELECT cfg, turns, inner_, o, d, theta, bit, bit / greatest(n - 1, 1)::DOUBLE AS t, h, w, floor(least(h, w) / 3) AS radius FROM g, z, (SELECT n, unnest(range(0, n)) AS bit FROM n)),
         q AS (SELECT cfg, bit, h, w, round_even(h // 2 + a * sin(x), 0)::BIGINT AS r, round_even(w // 2 + a * cos(x), 0)::BIGINT AS c
               FROM (SELECT *, CASE WHEN o = 0 THEN radius * inner_ * (1 - t) + radius * t ELSE radius * (1 - t) + radius * inner_ * t END AS a, theta + CASE WHEN d = 0 THEN 1.0 ELSE -1.0 END * (t * turns * (2 * pi())) AS x FROM b)),
         u AS (SELECT DISTINCT r, c, h, w FROM q WHERE r >= 0 AND c >= 0 AND r < h AND c < w),
         m AS (SELECT u.r, u.c, sum(coalesce(v, 0))::DOUBLE / ((least(u.r + 1, any_value(h) - 1) - greatest(u.r - 1, 0) + 1) * (least(u.c + 1, any_value(w) - 1) - greatest(u.c - 1, 0) + 1)) / 255 AS sample
               FROM u, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) LEFT JOIN p ON p.r = u.r + dr AND p.c = u.c + dc GROUP BY u.r, u.c),
         a AS (SELECT cfg, bit, coalesce(sample, 0) AS sample, quantile_cont(coalesce(sample, 0), 0.5) OVER (PARTITION BY cfg) AS middle FROM q LEFT JOIN m USING (r, c)),
         e AS (SELECT cfg, name, avg(((sample >= middle)::INT <> on_)::INT) AS e FROM a JOIN k USING (bit) GROUP BY ALL),
         f AS (SELECT cfg, false AS invert, e AS error, name FROM e UNION ALL SELECT cfg, true, 1.0 - e, name FROM e)
    SELECT cfg::INT AS cfg, invert, round(min(error), 4) AS error, arg_min(name, (error, name)) AS name FROM f GROUP BY cfg, invert ORDER BY error, cfg, invert LIMIT 25
""")
def spiral_sweep(spark, sf_dir):
    """The 25 spiral readings of a raster of all lines (days by price) that come nearest to the bits of a region's name."""
    rows = table(spark, sf_dir, "lineitem").select(F.expr("datediff(l_shipdate, date'1992-01-01') div 40").alias("r"), F.floor(F.col("l_extendedprice") / 1100).alias("c"))
    cells = rows.filter("r >= 0 and c >= 0").groupBy("r", "c").agg(F.least(F.lit(255), F.count("*") * 20).alias("v"))
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    known = names.select("name", F.posexplode(F.split(text.text_to_bits(F.col("name")), "")).alias("bit", "on")).filter("on in ('0', '1')").withColumn("on", F.col("on").cast("int"))
    n_bits = known.agg(F.max("bit") + 1).first()[0]
    configs = spiral.sweep_grid(spark, SWEEP_TURNS, theta_steps=SWEEP_STEPS)
    return spiral.spiral_sweep(cells, [], configs, known, n_bits, 25, TILE)


_ANGLES = ", ".join("{{'t': {0}, 'x': {1}, 'y': {2}}}".format(k, *hough.direction(k, 180)) for k in range(180))


@query(f"""
    WITH {_SLOTS}, a AS (SELECT unnest([{_ANGLES}]) AS a), v AS (SELECT kind, a.t::INT AS theta, (c * a.x + r * a.y + 32768) >> 16 AS rho, count(*) AS votes FROM q, a GROUP BY ALL), s AS (SELECT * FROM v WHERE votes >= 5),
         n AS (SELECT kind, votes, theta, rho, theta + i AS t, rho + j AS p FROM s, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i <> 0 OR j <> 0),
         b AS (SELECT kind, (t + 180) % 180 AS theta, CASE WHEN t < 0 OR t >= 180 THEN -p ELSE p END AS rho, max((votes, -theta, -rho)) AS rival FROM n GROUP BY ALL)
    SELECT s.kind, s.theta, s.rho, s.votes FROM s LEFT JOIN b ON b.kind = s.kind AND b.theta = s.theta AND b.rho = s.rho WHERE rival IS NULL OR (s.votes, -s.theta, -s.rho) > rival
""")
def hough_lines(spark, sf_dir):
    """Lines of at least five cells of the event rasters that no line near them beats."""
    votes = hough.line_votes(event_cells(spark, sf_dir), ["kind"])
    return hough.local_peaks(votes, ["kind"], 5)


@query(f"""
    WITH {_SHIPS}, x AS (SELECT *, {_STEP("v", "c", "r")} AS x1, {_STEP("v", "r", "c")} AS y1 FROM g),
         s AS (SELECT flag, r, c, {_SUM3("x1", "r", "c")}::DOUBLE AS gx, {_SUM3("y1", "c", "r")}::DOUBLE AS gy FROM x), m AS (SELECT flag, r, c, sqrt(gx * gx + gy * gy) AS mag FROM s WHERE gx <> 0 OR gy <> 0),
         t AS (SELECT flag, quantile_cont(mag, 0.9) AS least FROM m GROUP BY flag), e AS (SELECT flag, r, c FROM m JOIN t USING (flag) WHERE mag > least + 1e-9), a AS (SELECT unnest([{_ANGLES}]) AS a),
         v AS (SELECT flag, a.t AS theta, (c * a.x + r * a.y + 32768) >> 16 AS rho, count(*) AS votes FROM e, a GROUP BY ALL)
    SELECT flag, coalesce(max(votes), 0) AS votes, round(100 * coalesce(max(votes), 0) / sqrt(any_value(h) * any_value(h) + any_value(w) * any_value(w)), 4) + 0.0 AS score FROM z LEFT JOIN v USING (flag) GROUP BY flag
""")
def raster_line_score(spark, sf_dir):
    """The most strong gradients on one line of each shipping raster."""
    out = hough.line_score(ship_raster(spark, sf_dir), ["flag"], tile=TILE)
    return out.select("flag", "votes", r6("score", 4).alias("score"))
