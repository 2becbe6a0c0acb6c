"""Token statistics of documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from structlab.operators import graph, sequence
from structlab.plans.registry import query, r6, table, words


def doc_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("lang", "source", F.col("doc_id").alias("seq"), F.posexplode(words()).alias("ord", "token"))


def event_tokens(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), "ts", "event_id", F.col("event_type").alias("token"))


EVENT_PAIRS = """
    p AS (SELECT user_id, event_type AS x, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events),
    j AS (SELECT x, y, count(*) AS c FROM p WHERE y IS NOT NULL GROUP BY ALL)
"""


@query(f"""
    WITH {EVENT_PAIRS}, m AS (SELECT x, sum(c) AS n FROM j GROUP BY x)
    SELECT sum(c)::BIGINT AS n_pairs, round(-sum(c * log2(c / n)) / sum(c), 6) + 0.0 AS cond_entropy FROM j JOIN m USING (x)
""")
def cond_bigram_entropy_events(spark, sf_dir):
    pairs = sequence.bigrams(event_tokens(spark, sf_dir), order=["ts", "event_id"])
    out = sequence.conditional_entropy(pairs)
    return out.select("n_pairs", r6("cond_entropy").alias("cond_entropy"))


@query("""
    WITH t AS (SELECT user_id, ts, event_id, event_type, lead(event_type) OVER (ORDER BY user_id, ts, event_id) AS y FROM events),
         j AS (SELECT event_type AS x, y, count(*) AS c FROM t WHERE y IS NOT NULL GROUP BY ALL), m AS (SELECT x, sum(c) AS n FROM j GROUP BY x)
    SELECT sum(c)::BIGINT AS n_pairs, round(-sum(c * log2(c / n)) / sum(c), 6) + 0.0 AS cond_entropy FROM j JOIN m USING (x)
""")
def cond_bigram_entropy_cross(spark, sf_dir):
    pairs = sequence.bigrams(event_tokens(spark, sf_dir), order=["ts", "event_id"], cross=True)
    out = sequence.conditional_entropy(pairs)
    return out.select("n_pairs", r6("cond_entropy").alias("cond_entropy"))


WORDS = "w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS token FROM documents)"


@query(f"""
    WITH {WORDS}, c AS (SELECT lang, token, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT lang, sum(c) AS n, count(*) AS k FROM c GROUP BY lang)
    SELECT lang, max(n)::BIGINT AS n_tokens, max(k)::BIGINT AS n_kinds, round(-sum(c / n * log2(c / n)), 6) + 0.0 AS entropy,
           round(sum(c * (c - 1)) / (max(n) * (max(n) - 1)), 9) + 0.0 AS ioc, round(-sum(c / n * log2(c / n)) / log2(max(k)), 6) + 0.0 AS share_of_max
    FROM c JOIN n USING (lang) GROUP BY lang
""")
def unigram_entropy_by_lang(spark, sf_dir):
    out = sequence.unigram_entropy(doc_words(spark, sf_dir), ["lang"])
    return out.select("lang", "n_tokens", "n_kinds", r6("entropy").alias("entropy"), r6("ioc", 9).alias("ioc"), r6("share_of_max").alias("share_of_max"))


@query("""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS t FROM documents),
         p AS (SELECT t[i] AS x, t[i + 1] AS y FROM w, LATERAL (SELECT unnest(range(1, len(t))) AS i)),
         c AS (SELECT x, y, count(*) AS c FROM p GROUP BY ALL)
    SELECT x, y, c::BIGINT AS c FROM c ORDER BY c DESC, x, y LIMIT 50
""")
def top_bigrams_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(words().alias("t"))
    pairs = docs.select(F.explode(F.arrays_zip(F.col("t").alias("x"), F.slice("t", 2, F.size("t")).alias("y"))).alias("p")).select("p.*")
    return sequence.top_bigrams(pairs.filter("y is not null"), 50)


@query("""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS t FROM documents),
         g AS (SELECT doc_id, array_to_string(t[i:i + 2], ' ') AS ngram FROM w, LATERAL (SELECT unnest(range(1, len(t) - 1)) AS i)),
         c AS (SELECT ngram, count(*) AS n_total, count(DISTINCT doc_id) AS n_seqs FROM g GROUP BY ngram HAVING count(DISTINCT doc_id) >= 2)
    SELECT ngram, n_total, n_seqs FROM c ORDER BY n_seqs DESC, n_total DESC, ngram LIMIT 20
""")
def ngram_common_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", words().alias("t"))
    return sequence.common_ngrams(docs, "t", "doc_id", 3, 2, 20)


@query("""
    WITH t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
         g AS (SELECT *, (ord - lag(ord) OVER (PARTITION BY user_id, event_type ORDER BY ord))::DOUBLE AS gap FROM t),
         a AS (SELECT user_id, event_type, count(*) AS n, min(ord) AS first, max(ord) AS last, avg(gap) AS m, stddev_pop(gap) AS s FROM g GROUP BY ALL HAVING count(*) >= 2)
    SELECT user_id, event_type, n, first::BIGINT AS first, last::BIGINT AS last, round(m, 6) + 0.0 AS gap_mean, round(s / nullif(m, 0), 6) + 0.0 AS gap_cv,
           CASE WHEN n < 3 THEN 'pair' WHEN s / m <= 0.25 THEN 'regular' WHEN s / m >= 1 THEN 'clustered' ELSE 'scattered' END AS layout
    FROM a
""")
def repeat_structure_users(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", "event_type", (F.row_number().over(w) - 1).alias("ord"))
    out = sequence.repeat_structure(rows, ["user_id"], "event_type", "ord")
    return out.select("user_id", "event_type", "n", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), r6("gap_mean").alias("gap_mean"), r6("gap_cv").alias("gap_cv"), "layout")


@query("""
    WITH RECURSIVE w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM benchmark),
    s AS (
        SELECT item_id, t, 0 AS i, []::VARCHAR[] AS seen, '' AS phrase FROM w
        UNION ALL
        SELECT item_id, t, i + 1, CASE WHEN list_contains(seen, p) THEN seen ELSE list_append(seen, p) END, CASE WHEN list_contains(seen, p) THEN p ELSE '' END
        FROM (SELECT *, CASE WHEN phrase = '' THEN t[i + 1] ELSE phrase || '|' || t[i + 1] END AS p FROM s WHERE i < len(t))
    )
    SELECT item_id, len(seen)::BIGINT AS n_phrases, len(t)::BIGINT AS n_tokens FROM s WHERE i = len(t)
""")
def lz78_benchmark(spark, sf_dir):
    return lz78(table(spark, sf_dir, "benchmark").select("item_id", words().alias("t")))


def lz78(items):
    return items.select("item_id", sequence.lz78_phrases(F.col("t")).cast("long").alias("n_phrases"), F.size("t").cast("long").alias("n_tokens"))


@query("""
    WITH w AS (SELECT lang, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS n FROM documents)
    SELECT lang, count(*) AS n_docs, min(n)::BIGINT AS shortest, max(n)::BIGINT AS longest, round(avg(n), 6) + 0.0 AS mean_words, round(quantile_cont(n, 0.5), 6) + 0.0 AS median_words
    FROM w GROUP BY lang
""")
def word_length_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.size(words()).alias("n"))
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.min("n").cast("long").alias("shortest"), F.max("n").cast("long").alias("longest"), r6(F.avg("n")).alias("mean_words"), r6(F.percentile("n", F.lit(0.5))).alias("median_words")
    )


@query(f"""
    WITH {WORDS}, k AS (SELECT DISTINCT lang, token FROM w), s AS (SELECT lang, count(*) AS n FROM k GROUP BY lang),
         b AS (SELECT a.lang AS a, b.lang AS b, count(*) AS hits FROM k a JOIN k b ON a.token = b.token AND a.lang < b.lang GROUP BY ALL)
    SELECT x.lang AS a, y.lang AS b, coalesce(hits, 0)::BIGINT AS shared, (x.n - coalesce(hits, 0))::BIGINT AS only_a, (y.n - coalesce(hits, 0))::BIGINT AS only_b,
           round(coalesce(hits, 0) / (x.n + y.n - coalesce(hits, 0)), 6) + 0.0 AS jaccard
    FROM s x JOIN s y ON x.lang < y.lang LEFT JOIN b ON b.a = x.lang AND b.b = y.lang
""")
def jaccard_lang_pairs(spark, sf_dir):
    kinds = doc_words(spark, sf_dir).select("lang", "token").distinct()
    sizes = kinds.groupBy("lang").agg(F.count("*").alias("n"))
    both = kinds.select("token", F.col("lang").alias("a")).join(kinds.select("token", F.col("lang").alias("b")), "token").filter("a < b")
    both = both.groupBy("a", "b").agg(F.count("*").alias("both"))
    pairs = sizes.select(F.col("lang").alias("a"), F.col("n").alias("na")).join(sizes.select(F.col("lang").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    out = pairs.join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("both", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("shared")
    return out.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"), r6(F.col("shared") / union).alias("jaccard"))


TOP_SOURCE = """
    w AS (SELECT source, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS t FROM documents WHERE lang = 'en'),
    p AS (SELECT source, t[i] AS x, t[i + 1] AS y FROM w, LATERAL (SELECT unnest(range(1, len(t))) AS i)),
    c AS (SELECT source, x, y, count(*) AS c FROM p GROUP BY ALL)
"""


def source_bigrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'").select("source", words().alias("t"))
    pairs = docs.select("source", F.explode(F.arrays_zip(F.col("t").alias("x"), F.slice("t", 2, F.size("t")).alias("y"))).alias("p")).select("source", "p.*")
    return pairs.filter("y is not null").groupBy("source", "x", "y").agg(F.count("*").alias("c"))


@query(f"""
    WITH {TOP_SOURCE}, top AS (SELECT source, x, y, c FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, x, y) <= 100),
         m AS (SELECT a.source AS a, b.source AS b, count(*) AS k FROM top a JOIN top b ON a.x = b.x AND a.y = b.y AND a.c = b.c AND a.source < b.source GROUP BY ALL),
         n AS (SELECT source, count(*) AS n FROM top GROUP BY source)
    SELECT a, b, k AS shared, round(k / (x.n + y.n - k), 6) + 0.0 AS jaccard FROM m JOIN n x ON x.source = a JOIN n y ON y.source = b
""")
def bigram_jaccard_counts(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("c"), "x", "y")
    top = source_bigrams(spark, sf_dir).withColumn("rn", F.row_number().over(w)).filter("rn <= 100").drop("rn")
    n = top.groupBy("source").agg(F.count("*").alias("n"))
    both = top.select("x", "y", "c", F.col("source").alias("a")).join(top.select("x", "y", "c", F.col("source").alias("b")), ["x", "y", "c"]).filter("a < b")
    both = both.groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = both.join(n.select(F.col("source").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("source").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "shared", r6(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


@query(f"""
    WITH {TOP_SOURCE}, f AS (SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.c, 0) AS ca, coalesce(b.c, 0) AS cb
              FROM (SELECT * FROM c WHERE source = 'src0') a FULL JOIN (SELECT * FROM c WHERE source = 'src1') b ON a.x = b.x AND a.y = b.y),
         t AS (SELECT * FROM f ORDER BY ca + cb DESC, x, y LIMIT 200),
         r AS (SELECT rank() OVER (ORDER BY ca) + (count(*) OVER (PARTITION BY ca) - 1) / 2 AS ra, rank() OVER (ORDER BY cb) + (count(*) OVER (PARTITION BY cb) - 1) / 2 AS rb FROM t)
    SELECT count(*) AS n, round(1 - 6 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1)), 6) + 0.0 AS rho FROM r
""")
def spearman_bigram_sources(spark, sf_dir):
    c = source_bigrams(spark, sf_dir)
    a, b = (c.filter(F.col("source") == s).select("x", "y", F.col("c").alias(n)) for s, n in (("src0", "ca"), ("src1", "cb")))
    top = a.join(b, ["x", "y"], "full").fillna(0, ["ca", "cb"]).orderBy(F.desc(F.col("ca") + F.col("cb")), "x", "y").limit(200)
    return sequence.spearman_closed(top, "ca", "cb").select("n", r6("rho").alias("rho"))


@query(f"""
    WITH {WORDS}, c AS (SELECT lang, token, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT lang, sum(c) AS n FROM c GROUP BY lang),
         p AS (SELECT lang, -sum(c / n * log2(c / n)) AS h, sum(c * (c - 1)) / (max(n) * (max(n) - 1)) AS ic, log2(count(*)) AS top FROM c JOIN n USING (lang) GROUP BY lang)
    SELECT a.lang AS a, b.lang AS b, round(sqrt((a.h - b.h) ** 2 + (a.ic - b.ic) ** 2 + (a.h / a.top - b.h / b.top) ** 2), 6) + 0.0 AS distance FROM p a JOIN p b ON a.lang < b.lang
""")
def profile_distance_lang(spark, sf_dir):
    p = sequence.unigram_entropy(doc_words(spark, sf_dir), ["lang"]).select("lang", F.array("entropy", "ioc", "share_of_max").alias("v"))
    pairs = p.select(F.col("lang").alias("a"), F.col("v").alias("va")).join(p.select(F.col("lang").alias("b"), F.col("v").alias("vb")), F.col("a") < F.col("b"))
    squares = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("a", "b", r6(F.sqrt(squares)).alias("distance"))


@query(f"""
    WITH {EVENT_PAIRS}, e AS (SELECT DISTINCT x, y FROM j), k AS (SELECT x, count(*) AS k FROM e WHERE x <> y GROUP BY x),
         l AS (SELECT a.x AS v, count(*) AS links FROM e a JOIN e b ON b.x = a.y JOIN e d ON d.x = a.x AND d.y = b.y WHERE a.x <> a.y AND b.x <> b.y AND d.x <> d.y GROUP BY a.x),
         n AS (SELECT count(*) AS n FROM (SELECT x FROM e UNION SELECT y FROM e))
    SELECT n::BIGINT AS n_nodes, (SELECT count(*) FROM e) AS n_edges, round(2 * (SELECT count(*) FROM e) / (n * (n - 1)), 6) + 0.0 AS density,
           round((SELECT count(*) FROM e) / n, 6) + 0.0 AS mean_out_degree,
           round((SELECT count(*) FROM e a JOIN e b ON a.x = b.y AND a.y = b.x) / (SELECT count(*) FROM e), 6) + 0.0 AS reciprocity,
           round(coalesce((SELECT avg(coalesce(links, 0) / (k * (k - 1))) FROM k LEFT JOIN l ON v = x WHERE k > 1), 0), 6) + 0.0 AS clustering
    FROM n
""")
def transition_graph_stats(spark, sf_dir):
    pairs = sequence.bigrams(event_tokens(spark, sf_dir), order=["ts", "event_id"])
    out = graph.transition_stats(graph.transition_edges(pairs))
    return out.select("n_nodes", "n_edges", *[r6(c).alias(c) for c in ("density", "mean_out_degree", "reciprocity", "clustering")])


@query(f"""
    WITH {WORDS}, e AS (SELECT DISTINCT source, token FROM w), d AS (SELECT token, count(*) AS k FROM e GROUP BY token),
         g AS (SELECT k::DOUBLE AS v, row_number() OVER (ORDER BY k, token) AS r, count(*) OVER () AS n FROM d)
    SELECT (SELECT count(DISTINCT token) FROM e) AS n_left, (SELECT count(DISTINCT source) FROM e) AS n_right, (SELECT count(*) FROM e) AS n_edges,
           round((SELECT count(*) FROM e) / ((SELECT count(DISTINCT token) FROM e) * (SELECT count(DISTINCT source) FROM e)), 6) + 0.0 AS density,
           round((2 * sum(r * v) - (max(n) + 1) * sum(v)) / (max(n) * sum(v)), 6) + 0.0 AS gini
    FROM g
""")
def bipartite_gini(spark, sf_dir):
    """The Gini coefficient comes from counts per degree (few rows), so no window runs over all words."""
    edges = doc_words(spark, sf_dir).select("source", "token").distinct()
    stats = graph.bipartite_stats(edges, "token", "source")
    degrees = edges.groupBy("token").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = degrees.withColumn("ranks", F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2.0)
    n, total = F.sum("m").cast("double"), F.sum(F.col("m") * F.col("k")).cast("double")
    gini = rows.agg(((2.0 * F.sum(F.col("ranks") * F.col("k")) - (n + 1.0) * total) / (n * total)).alias("gini"))
    return stats.crossJoin(gini).select("n_left", "n_right", "n_edges", r6("density").alias("density"), r6("gini").alias("gini"))


@query("""
    WITH t AS (SELECT conv_id, role AS x, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS y FROM conversations)
    SELECT x, y, count(*) AS c FROM t WHERE y IS NOT NULL GROUP BY ALL
""")
def conversation_turn_bigram(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    pairs = sequence.bigrams(turns, seq="conv_id", order=["turn", "text"], token="role")
    return pairs.groupBy("x", "y").agg(F.count("*").alias("c"))


@query("""
    WITH t AS (SELECT user_id, event_id, event_type = 'purchase' AS num, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
         i AS (SELECT user_id, rn, rn - row_number() OVER (PARTITION BY user_id ORDER BY rn) AS island FROM t WHERE num),
         b AS (SELECT user_id, island, min(rn) AS s, max(rn) AS e, count(*) AS n FROM i GROUP BY ALL)
    SELECT n, count(*) AS n_blocks, min(s)::BIGINT AS first_start FROM b GROUP BY n
""")
def numeral_blocks_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", "event_type", F.row_number().over(w).alias("ord"))
    blocks = sequence.numeral_blocks(rows, ["user_id"], "ord", F.col("event_type") == "purchase")
    return blocks.groupBy("n").agg(F.count("*").alias("n_blocks"), F.min("start").cast("long").alias("first_start"))


@query("""
    WITH t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
         f AS (SELECT *, coalesce(rn < min(CASE WHEN event_type = 'purchase' THEN rn END) OVER (PARTITION BY user_id), true) AS header FROM t)
    SELECT header, event_type, count(*) AS n FROM f GROUP BY ALL
""")
def split_header_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", "event_type", F.row_number().over(w).alias("ord"))
    return sequence.split_header(rows, ["user_id"], "ord", F.col("event_type") == "purchase").groupBy("header", "event_type").agg(F.count("*").alias("n"))
