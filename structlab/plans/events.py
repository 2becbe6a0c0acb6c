"""Periods, circular statistics, tracks and nulls over events and measurements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from structlab.functions import sphere
from structlab.functions.rng import uniform
from structlab.operators import nulls, periodic, ranks, sequence, verdict
from structlab.plans.registry import micros, query, r6, seconds, sql_uniform, table

PERIODS = [3600.0 * h for h in range(2, 202)]
P = "(SELECT unnest(range(2, 202)) * 3600.0::DOUBLE AS period)"
FOLD = """
    f AS (SELECT {by} period, count(*) AS n, sum(cos(2 * pi() * ((t / period) - floor(t / period)))) AS c, sum(sin(2 * pi() * ((t / period) - floor(t / period)))) AS s
          FROM t CROSS JOIN {p} GROUP BY ALL),
    z AS (SELECT {by} period, n, 2.0 / n * (c * c + s * s) AS z2 FROM f)
"""
T = "t AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS t FROM events)"


@query(f"WITH {T}, {FOLD.format(by='', p=P)} SELECT period, n, round(z2, 4) + 0.0 AS z2 FROM z")
def z2_epoch_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(seconds("ts").alias("t"))
    return periodic.epoch_fold(events, "t", PERIODS).select("period", "n", r6("z2", 4).alias("z2"))


@query(f"""
    WITH {T}, {FOLD.format(by='event_type,', p=P)}
    SELECT event_type, arg_max(period, (z2, -period)) AS period, round(max(z2), 4) + 0.0 AS z2, arg_max(n, (z2, -period)) AS n FROM z GROUP BY event_type
""")
def z2_best_by_type(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", seconds("ts").alias("t"))
    best = periodic.best_period(periodic.epoch_fold(events, "t", PERIODS, ["event_type"]), ["event_type"])
    return best.select("event_type", "period", r6("z2", 4).alias("z2"), "n")


NULL_T = f"""
    b AS (SELECT min(epoch_us(ts)) / 1e6::DOUBLE AS lo, max(epoch_us(ts)) / 1e6::DOUBLE AS hi FROM events WHERE event_type = 'purchase'),
    e AS (SELECT event_id, trial FROM events CROSS JOIN (SELECT unnest(range(0, 20)) AS trial) WHERE event_type = 'purchase'),
    t AS (SELECT trial, lo + (hi - lo) * {sql_uniform("'fold'", 'trial::VARCHAR', 'event_id::VARCHAR')} AS t FROM e, b)
"""


@query(f"""
    WITH {NULL_T}, {FOLD.format(by='trial,', p="(SELECT unnest([86400.0::DOUBLE, 172800.0, 604800.0]) AS period)")}
    SELECT period, count(*) AS n_trials, round(avg(z2), 4) + 0.0 AS null_mean, round(quantile_cont(z2, 0.95), 4) + 0.0 AS null_q95 FROM z GROUP BY period
""")
def fold_null_uniform(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    bounds = events.agg((F.min(micros("ts")) / 1e6).alias("lo"), (F.max(micros("ts")) / 1e6).alias("hi"))
    rows = nulls.trials(events.select("event_id"), 20).crossJoin(F.broadcast(bounds))  # one row
    rows = rows.select("trial", (F.col("lo") + (F.col("hi") - F.col("lo")) * uniform("fold", F.col("trial"), F.col("event_id"))).alias("t"))
    z = periodic.epoch_fold(rows, "t", [86400.0, 172800.0, 604800.0], ["trial"])
    return z.groupBy("period").agg(F.count("*").alias("n_trials"), r6(F.avg("z2"), 4).alias("null_mean"), r6(F.percentile("z2", F.lit(0.95)), 4).alias("null_q95"))


@query("""
    WITH a AS (SELECT event_type, radians((hour(ts) * 60 + minute(ts)) * 0.25) AS a FROM events),
         s AS (SELECT event_type, count(*) AS n, avg(cos(a)) AS c, avg(sin(a)) AS s FROM a GROUP BY event_type)
    SELECT event_type, n, round(sqrt(c * c + s * s), 6) + 0.0 AS r, round(n * (c * c + s * s), 4) + 0.0 AS z, round(exp(-n * (c * c + s * s)), 6) + 0.0 AS p,
           round(degrees(sqrt(-2 * ln(sqrt(c * c + s * s)))), 4) + 0.0 AS circ_sd FROM s
""")
def rayleigh_hour_of_day(spark, sf_dir):
    angle = (F.hour("ts") * 60 + F.minute("ts")) * 0.25
    rows = table(spark, sf_dir, "events").select("event_type", angle.cast("double").alias("a"))
    out = rows.groupBy("event_type").agg(F.count("*").alias("n"), sphere.resultant(F.col("a")).alias("r"), sphere.rayleigh_z(F.col("a")).alias("z"), sphere.circular_std(F.col("a")).alias("sd"))
    return out.select("event_type", "n", r6("r").alias("r"), r6("z", 4).alias("z"), r6(F.exp(-F.col("z"))).alias("p"), r6("sd", 4).alias("circ_sd"))


@query("""
    WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6::DOUBLE AS gap FROM events)
    SELECT user_id, count(gap) AS n_gaps, round(avg(gap), 3) + 0.0 AS mean_gap, round(stddev_pop(gap) / nullif(avg(gap), 0), 6) + 0.0 AS cv FROM g WHERE gap IS NOT NULL GROUP BY user_id
""")
def interarrival_cv(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("us"))
    out = periodic.spacing_regularity(rows, "us", ["user_id"])
    return out.select("user_id", "n_gaps", r6(F.col("mean_gap") / 1e6, 3).alias("mean_gap"), r6("cv").alias("cv"))


@query("""
    WITH p AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS y FROM events WHERE value IS NOT NULL),
         d AS (SELECT user_id, t, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
         v AS (SELECT user_id, t, dt, dx / dt AS vx, dy / dt AS vy FROM d WHERE dt > 0),
         a AS (SELECT user_id, sqrt(vx * vx + vy * vy) AS speed, (vx - lag(vx) OVER w) / dt AS ax, (vy - lag(vy) OVER w) / dt AS ay FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t))
    SELECT user_id, count(*) AS n_steps, round(max(speed), 6) + 0.0 AS max_speed, round(max(sqrt(ax * ax + ay * ay)), 6) + 0.0 AS max_accel FROM a GROUP BY user_id
""")
def track_kinematics(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("value is not null")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("double")
    rows = events.select("user_id", seconds("ts").alias("t"), F.col("value").alias("x"), order.alias("y"))
    out = periodic.track_kinematics(rows, ["user_id"], "t", "x", "y")
    return out.select("user_id", "n_steps", r6("max_speed").alias("max_speed"), r6("max_accel").alias("max_accel"))


@query("""
    WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd FROM events GROUP BY event_type)
    SELECT event_type, event_id, round(value / nullif(med, 0), 6) + 0.0 AS norm FROM events JOIN m USING (event_type) WHERE abs(value / nullif(med, 0) - 1) > 3 * sd / abs(med)
""")
def dip_extraction_3sigma(spark, sf_dir):
    out = periodic.sigma_dips(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value")
    return out.select("event_type", "event_id", r6("norm").alias("norm"))


@query("""
    WITH d AS (SELECT date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY day) AS i, v - avg(v) OVER () AS v FROM d),
         k AS (SELECT unnest(range(0, 8)) AS lag), r AS (SELECT lag, sum(a.v * b.v) AS r FROM k, n a JOIN n b ON b.i = a.i + 0 + lag GROUP BY lag)
    SELECT lag::INTEGER AS lag, round(r / (SELECT r FROM r WHERE lag = 0), 6) + 0.0 AS r FROM r
""")
def autocorr_daily(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v")).withColumn("series", F.lit(1))
    return periodic.autocorrelation(daily, ["series"], "day", "v", 7).select("lag", r6("r").alias("r"))


@query("""
    WITH d AS (SELECT date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n, v - avg(v) OVER () AS v FROM d),
         h AS (SELECT i, n, v * (0.5 - 0.5 * cos(2 * pi() * i / nullif(n - 1, 0))) AS v, unnest(range(1, 11)) AS k FROM n),
         s AS (SELECT k, sum(v * cos(2 * pi() * ((k * i / n) % 1.0))) AS c, sum(v * sin(2 * pi() * ((k * i / n) % 1.0))) AS s FROM h GROUP BY k)
    SELECT 1 AS series, k::INTEGER AS k, round(c * c + s * s, 2) + 0.0 AS power FROM s
""")
def power_spectrum_daily(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v")).withColumn("series", F.lit(1))
    return periodic.power_spectrum(daily, ["series"], "day", "v", 10).select("series", "k", r6("power", 2).alias("power"))


N_TRIALS = 40


@query(f"""
    WITH e AS (SELECT event_id AS pos, event_type FROM events), k AS (SELECT unnest(range(0, {N_TRIALS})) AS trial),
         a AS (SELECT trial, pos, row_number() OVER (PARTITION BY trial ORDER BY pos) AS rn FROM e, k),
         b AS (SELECT trial, event_type AS tok, row_number() OVER (PARTITION BY trial ORDER BY md5('shuffle|' || trial || '|' || pos), pos) AS rn FROM e, k),
         s AS (SELECT trial, pos, tok FROM a JOIN b USING (trial, rn) UNION ALL SELECT -1, pos, event_type FROM e),
         p AS (SELECT trial, tok AS x, lead(tok) OVER (PARTITION BY trial ORDER BY pos) AS y FROM s),
         j AS (SELECT trial, x, y, count(*) AS c FROM p WHERE y IS NOT NULL GROUP BY ALL), m AS (SELECT trial, x, sum(c) AS n FROM j GROUP BY ALL),
         h AS (SELECT trial, -sum(c * log2(c / n)) / sum(c) AS h FROM j JOIN m USING (trial, x) GROUP BY trial),
         o AS (SELECT h AS o FROM h WHERE trial = -1)
    SELECT round(o, 6) + 0.0 AS observed, count(*) AS n_trials, round(avg(h), 6) + 0.0 AS null_mean, round(stddev_pop(h), 7) + 0.0 AS null_sd,
           round((o - avg(h)) / stddev_pop(h), 3) + 0.0 AS z, round(avg((h >= o)::INT), 6) + 0.0 AS p_ge, round(avg((h <= o)::INT), 6) + 0.0 AS p_le, stddev_pop(h) < 1e-12 AS null_degenerate
    FROM h, o WHERE trial >= 0 GROUP BY o
""")
def null_cond_entropy_events(spark, sf_dir):
    """Entropy of the next event type against shuffles of the stream: trials are rows, one plan for all."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("token"))
    observed = ranks.neighbour_counts(rows, [], ["pos"], "token")
    null = nulls.shuffled_neighbours(nulls.trials(rows, N_TRIALS), "token", ["pos"], ["trial"], "shuffle")
    out = nulls.summarize(sequence.conditional_entropy(observed), sequence.conditional_entropy(null, ["trial"]), "cond_entropy")
    return out.select(
        r6("observed").alias("observed"), "n_trials", r6("null_mean").alias("null_mean"), r6("null_sd", 7).alias("null_sd"), r6("z", 3).alias("z"), r6("p_ge").alias("p_ge"), r6("p_le").alias("p_le"), "null_degenerate"
    )


#: Values as whole millionths and means as whole billionths (floored): sums, sums of squares and quantiles of such numbers
#: don't depend on the order of their terms, so a tie rounds alike everywhere.
MEAN = "(sum(v) * 1000 // count(*))::HUGEINT"
HALF_UP = "floor(({}) / 1000 + 0.5) / 1e6"
N_BOOT = 30
Q_LOW, Q_HIGH = 0.05 * (N_BOOT - 1), 0.95 * (N_BOOT - 1)


def at_quantile(ordered: str, place: float, sql: bool = False) -> str:
    """The value at a place between two whole numbers of a sorted list, in hundredths exactly."""
    low, part = int(place), round(100 * (place - int(place)))
    pick = (lambda k: f"{ordered}[{k + 1}]") if sql else (lambda k: f"element_at({ordered}, {k + 1})")
    return f"({pick(low)} * {100 - part} + {pick(low + 1)} * {part})"


@query(f"""
    WITH e AS (SELECT user_id AS g, event_id AS pos, floor(value * 1e6 + 0.5)::BIGINT AS v FROM events WHERE value IS NOT NULL), k AS (SELECT unnest(range(0, {N_BOOT})) AS trial),
         n AS (SELECT g, pos, v, row_number() OVER w AS rn, count(*) OVER (PARTITION BY g) AS n FROM e WINDOW w AS (PARTITION BY g ORDER BY pos)),
         d AS (SELECT trial, g, floor({sql_uniform("'boot'", 'trial::VARCHAR', 'g::VARCHAR', 'pos::VARCHAR')} * n)::BIGINT + 1 AS rn FROM n, k),
         b AS (SELECT trial, {MEAN} AS m FROM d JOIN n USING (g, rn) GROUP BY trial),
         s AS (SELECT count(*) AS n, sum(m)::HUGEINT AS s, sum(m * m)::HUGEINT AS q, list(m ORDER BY m) AS l FROM b)
    SELECT {HALF_UP.format(f"(SELECT {MEAN} FROM e)::DOUBLE")} AS observed, n AS n_trials, {HALF_UP.format("s::DOUBLE / n")} AS null_mean,
           {HALF_UP.format("sqrt((n * q - s * s)::DOUBLE / (n * (n - 1)))")} AS null_sd,
           {HALF_UP.format(at_quantile("l", Q_LOW, True) + "::DOUBLE / 100")} AS null_q05, {HALF_UP.format(at_quantile("l", Q_HIGH, True) + "::DOUBLE / 100")} AS null_q95 FROM s
""")
def stratified_bootstrap_null(spark, sf_dir):
    """Mean value against resampling with replacement within each user."""
    return bootstrap_null(table(spark, sf_dir, "events"))


def bootstrap_null(events):
    rows = events.filter("value is not null").select(F.col("user_id").alias("g"), F.col("event_id").alias("pos"), F.floor(F.col("value") * 1e6 + 0.5).alias("v"))
    drawn = nulls.bootstrap(rows, "v", ["pos"], ["g"], "boot", N_BOOT)
    mean = F.expr("cast(sum(v) * 1000 div count(*) as decimal(18, 0))")
    null = drawn.groupBy("trial").agg(mean.alias("m"))
    sums = null.agg(F.count("*").alias("n"), F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).cast("decimal(38,0)").alias("q"), F.array_sort(F.collect_list("m")).alias("l"))  # a row per trial
    out = sums.crossJoin(rows.agg(mean.alias("o")))  # one row each
    half_up = lambda c: F.floor(c / 1000 + 0.5) / 1e6
    spread = F.expr("cast(n * q - s * s as double) / (n * (n - 1))")
    quantile = lambda place: F.expr(f"cast({at_quantile('l', place)} as double) / 100")
    return out.select(
        half_up(F.col("o").cast("double")).alias("observed"), F.col("n").alias("n_trials"), half_up(F.col("s").cast("double") / F.col("n")).alias("null_mean"), half_up(F.sqrt(spread)).alias("null_sd"),
        half_up(quantile(Q_LOW)).alias("null_q05"), half_up(quantile(Q_HIGH)).alias("null_q95"),
    )


@query("""
    WITH q AS (SELECT l_quantity AS v, (l_quantity % 5 = 0)::INT AS hit FROM lineitem)
    SELECT count(*) AS n, round(avg(hit), 6) + 0.0 AS observed, 0.0::DOUBLE AS null_sd, true AS null_degenerate FROM q
""")
def integer_multiplicity(spark, sf_dir):
    """Share of multiples of five.  Its null permutes a multiset, which leaves the share as it is: the null is
    degenerate by construction, so it is stated, not simulated."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.agg(F.count("*").alias("n"), r6(F.avg((F.col("l_quantity") % 5 == 0).cast("int"))).alias("observed"), F.lit(0.0).alias("null_sd"), F.lit(True).alias("null_degenerate"))


@query(f"""
    WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity AS v FROM lineitem), m AS (SELECT max(v) AS top FROM q), k AS (SELECT unnest(range(0, 20)) AS trial),
         u AS (SELECT trial, floor({sql_uniform("'half'", 'trial::VARCHAR', 'l_orderkey::VARCHAR', 'l_linenumber::VARCHAR')} * top * 2 + 0.5) / 2 AS v FROM q, m, k),
         c AS (SELECT trial, v, count(*) AS c FROM u GROUP BY ALL UNION ALL SELECT -1, v, count(*) FROM q GROUP BY v),
         h AS (SELECT trial, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM c GROUP BY trial)
    SELECT round((SELECT h FROM h WHERE trial = -1), 6) + 0.0 AS observed, round(avg(h), 6) + 0.0 AS null_mean, round(avg((h <= (SELECT h FROM h WHERE trial = -1))::INT), 6) + 0.0 AS p_le FROM h WHERE trial >= 0
""")
def entropy_vs_uniform(spark, sf_dir):
    return uniform_null(table(spark, sf_dir, "lineitem"))


def uniform_null(lineitem):
    rows = lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"))
    top = rows.agg(F.max("v").alias("top"))
    u = uniform("half", F.col("trial"), F.col("l_orderkey"), F.col("l_linenumber"))
    drawn = nulls.trials(rows.drop("v"), 20).crossJoin(F.broadcast(top)).select("trial", (F.floor(u * F.col("top") * 2 + 0.5) / 2).alias("v"))
    out = nulls.summarize(sequence.unigram_entropy(rows, [], "v"), sequence.unigram_entropy(drawn, ["trial"], "v"), "entropy")
    return out.select(r6("observed").alias("observed"), r6("null_mean").alias("null_mean"), r6("p_le").alias("p_le"))


@query("""
    SELECT event_type, count(*) AS n, count(DISTINCT value) AS n_unique, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.5), 6) + 0.0 AS median,
           round(stddev_samp(value), 6) + 0.0 AS sd, round(avg((value = round(value))::INT), 6) + 0.0 AS integer_share FROM events GROUP BY event_type
""")
def descriptive_stats(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct(v).alias("n_unique"), F.round(F.min(v), 6).alias("lowest"), F.round(F.max(v), 6).alias("highest"), r6(F.avg(v)).alias("mean"),
        r6(F.percentile(v, F.lit(0.5))).alias("median"), r6(F.stddev_samp(v)).alias("sd"), r6(F.avg((v == F.round(v)).cast("int"))).alias("integer_share"),
    )


@query("""
    WITH p AS (SELECT p_partkey, p_retailprice AS f, p_retailprice - 12.5 * floor(p_retailprice / 12.5) AS off FROM part)
    SELECT count(*) AS n, count(*) FILTER (least(off, 12.5 - off) <= 1.0) AS n_hits, 2 * 1.0 / 12.5 AS expected FROM p
""")
def comb_detector(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    hit = periodic.comb_hits(parts, "p_retailprice", 12.5, 1.0)
    return parts.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hits"), F.lit(2 * 1.0 / 12.5).alias("expected"))


@query("""
    WITH g AS (SELECT p_brand, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS gap FROM part)
    SELECT p_brand, count(gap) AS n_gaps, round(avg(gap), 6) + 0.0 AS mean_gap, round(stddev_pop(gap) / nullif(avg(gap), 0), 6) + 0.0 AS cv, coalesce(stddev_pop(gap) / nullif(avg(gap), 0) <= 0.05, false) AS regular
    FROM g WHERE gap IS NOT NULL GROUP BY p_brand
""")
def delta_regularity(spark, sf_dir):
    out = periodic.spacing_regularity(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])
    return out.select("p_brand", "n_gaps", r6("mean_gap").alias("mean_gap"), r6("cv").alias("cv"), "regular")


@query("""
    WITH s AS (SELECT event_type, value AS score FROM events WHERE value IS NOT NULL), t AS (SELECT quantile_cont(score, 0.99) AS threshold FROM s WHERE event_type IN ('view', 'click'))
    SELECT event_type, count(*) AS n, round(threshold, 6) + 0.0 AS threshold, round(avg((score >= threshold)::INT), 6) + 0.0 AS rate FROM s, t GROUP BY event_type, threshold
""")
def calibration_by_type(spark, sf_dir):
    scores = table(spark, sf_dir, "events").filter("value is not null").select("event_type", F.col("value").alias("score"))
    out = verdict.calibrate(scores, "event_type", "score", ["view", "click"])
    return out.select("event_type", "n", r6("threshold").alias("threshold"), r6("rate").alias("rate"))


@query("""
    WITH s AS (SELECT event_type, count(*) AS n, avg(cos(radians(hour(ts) * 15))) AS c, avg(sin(radians(hour(ts) * 15))) AS s FROM events GROUP BY 1),
         v AS (SELECT event_type, n, n * (c * c + s * s) AS z, exp(-n * (c * c + s * s)) AS p FROM s)
    SELECT event_type, n, round(z, 4) + 0.0 AS z, CASE WHEN n < 6 THEN 'UNDERDETERMINED' WHEN p < 0.01 AND abs(z) > 2.6 THEN 'STRUCTURE' ELSE 'NO_STRUCTURE' END AS verdict FROM v
""")
def verdict_catalog(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.hour("ts") * 15.0).alias("a"))
    s = rows.groupBy("event_type").agg(F.count("*").alias("n"), sphere.rayleigh_z(F.col("a")).alias("z"))
    return s.select("event_type", "n", r6("z", 4).alias("z"), verdict.structure_verdict(F.exp(-F.col("z")), F.col("z"), F.col("n")).alias("verdict"))


PHRASES = ["free", "proof of", "password"]


@query("""
    SELECT doc_id, array_to_string(list_filter(['free', 'proof of', 'password'], lambda p: contains(lower(text), p)), ',') AS hits
    FROM documents WHERE contains(lower(text), 'free') OR contains(lower(text), 'proof of') OR contains(lower(text), 'password')
""")
def forbidden_phrase_guard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", verdict.forbidden_hits(F.col("text"), PHRASES).alias("h")).filter(F.size("h") > 0)
    return docs.select("doc_id", F.array_join("h", ",").alias("hits"))


@query("""
    WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS v FROM embeddings), g AS (SELECT label, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM e GROUP BY label)
    SELECT a.label AS a, b.label AS b, round((a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)), 6) + 0.0 AS cohens_d, round((a.m - b.m) / sqrt(a.s / a.n + b.s / b.n), 6) + 0.0 AS welch_z
    FROM g a JOIN g b ON a.label = 0 AND b.label = 1
""")
def embedding_cohens_d(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("v"))
    out = verdict.group_effects(rows, "label", 0, 1, "v")
    return out.select(F.lit(0).alias("a"), F.lit(1).alias("b"), r6("cohens_d").alias("cohens_d"), r6("welch_z").alias("welch_z"))
