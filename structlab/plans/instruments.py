"""Sky, plane, token, rule and grid functions over the tables, each beside its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from structlab.functions import dates, ratio, sphere, text
from structlab.operators import graph, grid, joins, sequence, spatial, verdict
from structlab.plans.registry import query, r6, table
from structlab.plans.space import SITES, hour_grid, plane, sites
from structlab.plans.space import GRID as HOURS
from structlab.plans.space import PLANE


@query(f"""
    WITH {SITES}, p AS (SELECT nation, (lon + 180) / 15 AS ra, lat AS dec, 1950 + id % 80 AS y FROM s),
         q AS (SELECT nation, ra, (ra + (2000 - y) * (3.07496 + 1.33621 * sin(radians(ra * 15)) * tan(radians(dec))) / 3600 + 24) % 24 AS ra2, dec + (2000 - y) * 20.0431 * cos(radians(ra * 15)) / 3600 AS dec2, dec FROM p)
    SELECT nation, count(*) AS n, round(avg(ra2), 6) + 0.0 AS ra_h, round(avg(dec2), 6) + 0.0 AS dec,
           round(max(degrees(acos(least(1, greatest(-1, sin(radians(dec)) * sin(radians(dec2)) + cos(radians(dec)) * cos(radians(dec2)) * cos(radians((ra - ra2) * 15))))))), 5) + 0.0 AS most_moved FROM q GROUP BY nation
""")
def precession_sites(spark, sf_dir):
    """Positions of an epoch per site carried to J2000, and how far they moved at most."""
    p = sites(spark, sf_dir).select("nation", ((F.col("lon") + 180) / 15).alias("ra"), F.col("lat").alias("dec"), (1950 + F.col("id") % 80).alias("y"))
    q = p.withColumn("q", sphere.precess(F.col("ra"), F.col("dec"), F.col("y"), 2000))
    moved = sphere.angular_sep_acos(F.col("ra"), F.col("dec"), F.col("q.ra_h"), F.col("q.dec"))
    return q.groupBy("nation").agg(F.count("*").alias("n"), r6(F.avg("q.ra_h")).alias("ra_h"), r6(F.avg("q.dec")).alias("dec"), r6(F.max(moved), 5).alias("most_moved"))


@query(f"""
    WITH {SITES}, p AS (SELECT nation, lat, -90 + 180 * (id % 97) / 96.0::DOUBLE AS dec, (id % 360)::DOUBLE AS h FROM s), c AS (SELECT *, -tan(radians(lat)) * tan(radians(dec)) AS c FROM p),
         r AS (SELECT nation, CASE WHEN c < -1 THEN 'circumpolar' WHEN c > 1 THEN 'never_rises' ELSE 'rises' END AS state, CASE WHEN abs(c) <= 1 THEN degrees(acos(c)) / 15 END AS hours,
                      degrees(asin(least(1, greatest(-1, sin(radians(lat)) * sin(radians(dec)) + cos(radians(lat)) * cos(radians(dec)) * cos(radians(h)))))) AS alt FROM c)
    SELECT state, count(*) AS n, round(avg(hours), 6) + 0.0 AS hours, round(avg(alt), 6) + 0.0 AS altitude FROM r GROUP BY state
""")
def star_rising(spark, sf_dir):
    """Whether a star of some declination rises at each site, when, and how high it stands at some hour angle."""
    p = sites(spark, sf_dir).select("lat", (-90 + 180 * (F.col("id") % 97) / 96.0).alias("dec"), (F.col("id") % 360).cast("double").alias("h"))
    r = p.select(sphere.rise_hour_angle(F.col("lat"), F.col("dec")).alias("r"), sphere.altitude(F.col("lat"), F.col("dec"), F.col("h")).alias("alt"))
    return r.groupBy("r.state").agg(F.count("*").alias("n"), r6(F.avg("r.hours")).alias("hours"), r6(F.avg("alt")).alias("altitude"))


@query("""
    WITH p AS (SELECT c_mktsegment AS kind, c_acctbal AS a, (c_custkey * 37 % 720)::DOUBLE AS b FROM customer), d AS (SELECT kind, a, b, ((a - b) % 360 + 360) % 360 AS m, ((a + 180 - b) % 360 + 360) % 360 AS o, abs(a - b) AS w FROM p)
    SELECT kind, count(*) AS n, round(avg(least(m, 360 - m)), 6) + 0.0 AS direction, round(avg(least(w, 360 - w)), 6) + 0.0 AS raw, round(avg(least(least(m, 360 - m), least(o, 360 - o))), 6) + 0.0 AS axis FROM d GROUP BY kind
""")
def angle_deltas(spark, sf_dir):
    """Smaller angles between directions, with and without a modulus, and between axes."""
    p = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") * 37 % 720).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg(sphere.angle_delta(a, b))).alias("direction"), r6(F.avg(sphere.angle_delta_raw(a, b))).alias("raw"), r6(F.avg(sphere.axis_delta(a, b))).alias("axis"))


_PLANE = "SELECT nation, (lon - (SELECT avg(lon) FROM s)) * cos(radians((SELECT avg(lat) FROM s))) * {k} AS x, (lat - (SELECT avg(lat) FROM s)) * {k} AS y FROM s".format(k=3.141592653589793 / 180 * sphere.EARTH_KM)


@query(f"""
    WITH {SITES}, p AS ({_PLANE}) SELECT nation, count(*) AS n, round(avg(x), 4) + 0.0 AS x, round(avg(y), 4) + 0.0 AS y,
         count(*) FILTER (x > -4000 AND x < 5000 AND y > -3000 AND y < 2000 AND NOT (x > 0 AND y > 0)) AS n_inside FROM p GROUP BY nation
""")
def projected_sites(spark, sf_dir):
    """Sites in kilometres about their centre, and how many lie in an L-shaped polygon."""
    p = spatial.project_km(sites(spark, sf_dir), "lat", "lon")
    ring = [(-4000.0, -3000.0), (5000.0, -3000.0), (5000.0, 0.0), (0.0, 0.0), (0.0, 2000.0), (-4000.0, 2000.0)]
    return p.groupBy("nation").agg(F.count("*").alias("n"), r6(F.avg("x"), 4).alias("x"), r6(F.avg("y"), 4).alias("y"), F.count_if(spatial.points_in_polygon(p, ring, "x", "y")).alias("n_inside"))


@query("""
    WITH p AS (SELECT s_suppkey AS k, 15.0::DOUBLE * ((s_suppkey * 7 % 24) + (s_suppkey * 13 % 60) / 60.0 + (s_suppkey % 600) / 36000.0) AS ra, (s_suppkey % 90 + (s_suppkey * 17 % 60) / 60.0 + (s_suppkey * 29 % 60) / 3600.0)::DOUBLE * CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END AS dec FROM supplier)
    SELECT k, round(ra, 6) + 0.0 AS ra_deg, round(dec, 6) + 0.0 AS dec_deg FROM p WHERE k % 11 <> 5
""")
def designations(spark, sf_dir):
    """Positions read from names such as J0713+1700; names without one give none."""
    k = F.col("s_suppkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tenth = k % 600
    name = F.concat(F.lit("PSR J"), two(k * 7 % 24), two(k * 13 % 60), two(F.floor(tenth / 10)), F.lit("."), (tenth % 10).cast("string"), F.when(k % 3 == 0, "-").otherwise("+"), two(k % 90), two(k * 17 % 60), two(k * 29 % 60))
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), F.when(k % 11 == 5, "PSR B0329").otherwise(name).alias("name"))
    return rows.withColumn("p", text.parse_j2000(F.col("name"))).filter("p is not null").select("k", r6("p.ra_deg").alias("ra_deg"), r6("p.dec_deg").alias("dec_deg"))


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INT || '(N' || lpad((l_partkey % 60)::VARCHAR, 2, '0') || ')' ELSE 'M' || (l_partkey % 60) END AS sign FROM lineitem),
         n AS (SELECT *, regexp_full_match(sign, '[0-9]+\\(N[0-9]+[A-Za-z]?\\)') AS num, replace(replace(sign, '(', ''), ')', '') AS clean, CASE sign WHEN 'M7' THEN 'M1' WHEN 'M8' THEN 'M1' ELSE sign END AS named FROM t),
         h AS (SELECT *, coalesce(l_linenumber < min(CASE WHEN num THEN l_linenumber END) OVER (PARTITION BY l_orderkey), true) AS header FROM n)
    SELECT num, header, count(*) AS n, count(DISTINCT clean) AS n_clean, count(DISTINCT named) FILTER (named <> 'M2') AS n_named FROM h GROUP BY ALL
""")
def sign_classes(spark, sf_dir):
    """Numeral signs, marks taken out, aliases resolved, and what stands before a tablet's first numeral."""
    part = F.col("l_partkey") % 60
    sign = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_quantity").cast("int"), F.lit("(N"), F.lpad(part.cast("string"), 2, "0"), F.lit(")"))).otherwise(F.concat(F.lit("M"), part))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sign.alias("sign"))
    marked = t.withColumn("damaged", F.concat(F.lit("#"), "sign", F.lit("!?"))).withColumn("num", text.is_numeral_sign(F.col("sign")))
    h = sequence.split_header(marked, ["l_orderkey"], "l_linenumber", F.col("num"))
    named = text.normalize_tokens(F.array(F.concat("sign", F.lit("__"))), {"M7": "M1", "M8": "M1"}, ["M2"])
    rows = h.select("num", "header", text.clean_token(F.col("damaged")).alias("clean"), F.get(named, F.lit(0)).alias("named"))
    return rows.groupBy("num", "header").agg(F.count("*").alias("n"), F.count_distinct("clean").alias("n_clean"), F.count_distinct("named").alias("n_named"))


@query("""
    WITH a AS (SELECT item_id, list_transform(range(1, length(text) + 1), lambda i: lpad(bin(ascii(substr(text, i::INT, 1))), 32, '0')[-8:]) AS b FROM benchmark), s AS (SELECT item_id, array_to_string(b, '') AS bits FROM a),
         p AS (SELECT x.item_id, x.bits AS a, y.bits AS b, least(length(x.bits), length(y.bits)) AS n FROM s x JOIN s y ON y.item_id = x.item_id + 1)
    SELECT item_id, n::INT AS n, round(len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i])) / n::DOUBLE, 6) + 0.0 AS ber FROM p WHERE n > 0
""")
def bit_errors(spark, sf_dir):
    """Share of bits in which neighbouring texts differ, the bits written with spaces and a prefix and parsed again."""
    bits = text.text_to_bits(F.col("text"))
    spaced = F.concat(F.lit("0b"), F.regexp_replace(bits, "(.{8})", "$1 "))
    s = table(spark, sf_dir, "benchmark").select("item_id", text.parse_bits(spaced).alias("a"))
    p = s.join(s.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id").filter("length(a) > 0 and length(b) > 0")
    return p.select("item_id", F.least(F.length("a"), F.length("b")).alias("n"), r6(text.bit_error_rate(F.col("a"), F.col("b"))).alias("ber"))


@query("""
    WITH s AS (SELECT s_suppkey AS k, translate(md5(s_suppkey::VARCHAR), '0123456789abcdef', 'ACGTUMH6acgtNX-.') AS g FROM supplier),
         c AS (SELECT k, unnest(string_split(upper(g), '')) AS ch, unnest(range(0, 32)) AS i FROM s), b AS (SELECT k, string_agg(CASE ch WHEN 'A' THEN '00' WHEN 'C' THEN '01' WHEN 'G' THEN '10' WHEN 'T' THEN '11' WHEN 'U' THEN '11' WHEN 'M' THEN '100' WHEN 'H' THEN '101' WHEN '6' THEN '110' ELSE '' END, '' ORDER BY i) AS bits,
               count(*) FILTER (ch IN ('G', 'C')) AS gc, count(*) FILTER (ch IN ('A', 'C', 'G', 'T', 'U')) AS known FROM c GROUP BY k)
    SELECT k, bits, round(gc / nullif(known, 0)::DOUBLE, 6) + 0.0 AS gc FROM b
""")
def genome_codes(spark, sf_dir):
    """Bits of bases, modified ones included, and the share of G and C."""
    g = F.translate(F.md5(F.col("s_suppkey").cast("string")), "0123456789abcdef", "ACGTUMH6acgtNX-.")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), text.genome_bits(g).alias("bits"), r6(text.gc_content(g)).alias("gc"))


_LETTERS = "regexp_replace(upper(text), '[^A-Z]', '', 'g')"


@query(f"""
    WITH t AS (SELECT lang, doc_id, {_LETTERS} AS w FROM documents WHERE regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*')), n AS (SELECT lang, doc_id, length(w)::DOUBLE AS n, list_transform(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''), lambda c: (length(w) - length(replace(w, c, '')))::DOUBLE) AS c FROM t)
    SELECT lang, count(*) AS n, round(avg(list_sum(list_transform(c, lambda k: k * (k - 1))) / (n * (n - 1))), 5) + 0.0 AS ic FROM n WHERE n > 1 GROUP BY lang
""")
def letter_coincidence(spark, sf_dir):
    """Index of coincidence of the letters of plain documents, by language."""
    d = table(spark, sf_dir, "documents").filter(text.is_pure_ascii(F.coalesce("text", F.lit("")))).select("lang", text.index_of_coincidence_letters(F.col("text")).alias("ic")).filter("ic is not null")
    return d.groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg("ic"), 5).alias("ic"))


@query("""
    WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'about ' || o_orderkey END AS d FROM orders),
         v AS (SELECT CASE WHEN length(d) = 10 AND d LIKE '____-%' THEN 'exact' WHEN length(d) = 7 AND d LIKE '____-%' THEN 'mid_month' WHEN regexp_full_match(d, '[0-9]{4}') THEN 'year_only' ELSE 'none' END AS basis, d FROM d)
    SELECT basis, count(*) AS n, min(CASE basis WHEN 'exact' THEN d::DATE WHEN 'mid_month' THEN (d || '-15')::DATE END) AS first, max(CASE basis WHEN 'exact' THEN d::DATE WHEN 'mid_month' THEN (d || '-15')::DATE END) AS last FROM v GROUP BY basis
""")
def partial_dates(spark, sf_dir):
    """Dates that are whole, lack the day, are a year only, or none."""
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    d = F.when(k == 0, F.date_format(o, "yyyy-MM-dd")).when(k == 1, F.date_format(o, "yyyy-MM")).when(k == 2, F.date_format(o, "yyyy")).otherwise(F.concat(F.lit("about "), "o_orderkey"))
    v = table(spark, sf_dir, "orders").select(dates.normalize_date(d).alias("v"))
    return v.groupBy("v.basis").agg(F.count("*").alias("n"), F.min("v.date").alias("first"), F.max("v.date").alias("last"))


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey AS token, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem), w AS (SELECT o_orderkey AS word, (o_orderkey % 5 + 1)::BIGINT AS n, coalesce(sum(o_orderkey % 5 + 1) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM orders)
    SELECT word % 100 AS part, count(*) AS n, sum((pos - first + 1) * token)::BIGINT AS weighted FROM t JOIN w ON pos >= first AND pos < first + n GROUP BY ALL
""")
def rechunked_tokens(spark, sf_dir):
    """The stream of suppliers dealt into words of given lengths."""
    from structlab.operators.ranks import global_ranks

    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("token"))
    stream = global_ranks(l, ["l_orderkey", "l_linenumber", "l_partkey", "token"], "pos").select("pos", "token")
    words = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("word"), (F.col("o_orderkey") % 5 + 1).alias("n"))
    out = joins.rechunk(stream, words)
    return out.groupBy((F.col("word") % 100).alias("part")).agg(F.count("*").alias("n"), F.sum((F.col("ord") + 1) * F.col("token")).alias("weighted"))


@query(f"""
    WITH {PLANE}, d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM d)
    SELECT id, other, rank::INT AS rank, round(d, 6) + 0.0 AS d FROM r WHERE rank <= 3
""")
def nearest_three(spark, sf_dir):
    """The three nearest other sites of each supplier."""
    out = spatial.nearest_points(plane(spark, sf_dir), "id", "x", "y", 60.0, 3)
    return out.select("id", "other", "rank", r6("d").alias("d"))


@query(f"""
    WITH {PLANE}, e AS (SELECT DISTINCT l_suppkey AS source, (l_suppkey * 7 + l_partkey) % (SELECT count(*) FROM p) AS target FROM lineitem)
    SELECT e.source, count(*) AS n, round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 4) + 0.0 AS length FROM e JOIN p a ON a.id = e.source JOIN p b ON b.id = e.target GROUP BY e.source
""")
def drawn_edges(spark, sf_dir):
    """Lengths of the edges of a drawn graph; edges with an unknown end are left out."""
    p = plane(spark, sf_dir)
    n = p.agg(F.count("*").alias("n"))  # one row
    e = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("source"), ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % F.col("n")).alias("target")).distinct()
    apart = lambda a, b: F.hypot(F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y"))
    return graph.edge_lengths(p, e, apart).groupBy("source").agg(F.count("*").alias("n"), r6(F.sum("length"), 4).alias("length"))


@query(f"""
    WITH {HOURS}, v AS (SELECT grid, n AS v FROM g), p AS (SELECT grid, v // 2 AS k, count(*) FILTER (v % 2 = 0) AS even, count(*) AS n FROM v GROUP BY ALL), x AS (SELECT grid, sum((even - n / 2) ** 2 / (n / 2)) AS chi2, count(*) AS n_pairs FROM p GROUP BY grid),
         h AS (SELECT grid, v, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT grid, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER a AS na, sum(n * v) OVER a AS sa FROM h WINDOW w AS (PARTITION BY grid ORDER BY v), a AS (PARTITION BY grid)),
         o AS (SELECT grid, v, coalesce(w0 * (na - w0) * (s0 / w0::DOUBLE - (sa - s0) / nullif(na - w0, 0)) ** 2, -1.0) AS b FROM c), t AS (SELECT grid, arg_max(v, (round(b, 6), -v)) AS threshold FROM o GROUP BY grid)
    SELECT grid, n_pairs, round(chi2, 6) + 0.0 AS chi2, threshold FROM x JOIN t USING (grid)
""")
def grey_statistics(spark, sf_dir):
    """Chi-square of neighbouring grey values and Otsu's threshold of the hour grids."""
    v = hour_grid(spark, sf_dir).select("grid", F.col("n").alias("v"))
    return grid.lsb_chi_square(v, ["grid"], "v").join(grid.otsu_threshold(v, ["grid"]), "grid").select("grid", "n_pairs", r6("chi2").alias("chi2"), "threshold")


@query("""
    WITH r AS (SELECT s_nationkey AS g, abs(s_acctbal) + 1 AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier), q AS (SELECT g, x / lag(x) OVER (PARTITION BY g ORDER BY k) AS ratio FROM r),
         s AS (SELECT g, count(ratio) AS n, avg(ratio) AS m, stddev_pop(ratio) AS sd FROM q WHERE ratio IS NOT NULL GROUP BY g)
    SELECT g, n, round(m, 5) + 0.0 AS mean_ratio, round(sd, 5) + 0.0 AS sd_ratio, coalesce(sd / m <= 0.05, false) AS log_spiral FROM s
""")
def radius_ratios(spark, sf_dir):
    """Ratios of successive radii, and whether they are those of a log spiral."""
    r = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", (F.abs("s_acctbal") + 1).alias("x"))
    out = grid.radius_sequence(r, ["g"], "s_suppkey", "x")
    return out.select("g", "n", r6("mean_ratio", 5).alias("mean_ratio"), r6("sd_ratio", 5).alias("sd_ratio"), "log_spiral")


@query("""
    WITH p AS (SELECT p_partkey AS k, p_retailprice / (500 + p_size) AS r FROM part), q AS (SELECT k, r, unnest(range(1, 13)) AS q FROM p), f AS (SELECT k, q, round(r * q) AS p, abs(round(r * q) / q - r) AS off FROM q)
    SELECT k, arg_min(q, (off, q))::INT AS q, arg_min(p, (off, q))::BIGINT AS p FROM f GROUP BY k
""")
def small_fractions(spark, sf_dir):
    """The nearest fraction with a denominator of at most twelve."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), ratio.nearest_fraction(F.col("p_retailprice") / (500 + F.col("p_size"))).alias("f"))
    return p.select("k", "f.q", "f.p")


@query("""
    WITH s AS (SELECT event_type AS kind, user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL), a AS (SELECT avg(m) AS mu, stddev_pop(m) AS sd FROM s), z AS (SELECT kind, n, (m - mu) / sd AS z FROM s, a)
    SELECT CASE WHEN n < 6 THEN 'UNDERDETERMINED' WHEN exp(-z * z / 2) < 0.2 AND abs(z) > 1.8 THEN 'STRUCTURE' ELSE 'NO_STRUCTURE' END AS verdict,
           CASE WHEN n < 3 THEN 'NULL_DEGENERATE' WHEN abs(z) >= 3 THEN 'STRONG' WHEN abs(z) >= 1.5 THEN 'WEAK' ELSE 'NONE' END AS band,
           CASE WHEN NOT n >= 4 THEN 'INSTRUMENT_FAILED' WHEN z > 1 THEN 'EVENT_STRUCTURE' ELSE 'NO_EVENT_STRUCTURE' END AS gate,
           CASE WHEN n < 6 AND z < 0 THEN 'few | low' WHEN n < 6 THEN 'few' WHEN z < 0 THEN 'low' ELSE 'plain' END AS labels, count(*) AS n FROM z GROUP BY ALL
""")
def verdict_rules(spark, sf_dir):
    """Verdicts on each user's mean value by event type: ordered rules, bands, a known-answer gate and joined labels."""
    s = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    a = s.agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"))  # one row
    z = s.crossJoin(F.broadcast(a)).select("n", ((F.col("m") - F.col("mu")) / F.col("sd")).alias("z"))
    n, zc = F.col("n"), F.col("z")
    return z.groupBy(
        verdict.structure_verdict(F.exp(-zc * zc / 2), zc, n, 6, 0.2, 1.8).alias("verdict"), verdict.z_bands(zc, n < 3).alias("band"),
        verdict.null_gate_verdict(n >= 4, zc, F.lit(1.0), "EVENT").alias("gate"), verdict.all_of((n < 6, "few"), (zc < 0, "low"), none="plain").alias("labels"),
    ).agg(F.count("*").alias("n"))


_CLAIMS = ("the", "for sale", "secret", "PASSWORD")


@query(f"""
    WITH h AS (SELECT source, list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{p.lower()}') THEN '{p}' END" for p in _CLAIMS)}], lambda x: x IS NOT NULL) AS hits FROM documents WHERE text IS NOT NULL)
    SELECT source, array_to_string(hits, ',') AS hits, count(*) AS n FROM h GROUP BY ALL
""")
def phrase_guard(spark, sf_dir):
    """Which phrases of a list occur in each document."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("source", F.array_join(verdict.forbidden_hits(F.col("text"), list(_CLAIMS)), ",").alias("hits"))
    return d.groupBy("source", "hits").agg(F.count("*").alias("n"))


@query("""
    WITH c AS (SELECT c_custkey AS k, c_name || CASE WHEN c_acctbal < 0 THEN ' -' ELSE '   ' END || replace(abs(c_acctbal)::VARCHAR, '.', ',') AS s, c_acctbal FROM customer)
    SELECT k % 10 AS part, round(sum(CASE WHEN k % 6 = 0 THEN NULL ELSE abs(c_acctbal) END), 2) + 0.0 AS total, count(*) FILTER (k % 6 <> 0) AS n, min(regexp_replace(s, ' +', ' ', 'g')) AS first FROM c GROUP BY ALL
""")
def cell_numbers(spark, sf_dir):
    """Numbers with a decimal comma, cells that hold none, and texts with runs of space."""
    shown = F.replace(F.abs("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    s = F.concat("c_name", F.when(F.col("c_acctbal") < 0, " -").otherwise("   "), shown)
    cell = F.when(F.col("c_custkey") % 6 == 0, "unknown").otherwise(F.concat(F.lit(" "), shown, F.lit(" ")))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("part"), text.to_number(cell).alias("v"), text.clean_space(s).alias("s"))
    return c.groupBy("part").agg(r6(F.sum("v"), 2).alias("total"), F.count("v").alias("n"), F.min("s").alias("first"))
