"""Codecs, ciphers, windows and bits over benchmark texts, pages and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from structlab.functions import text as tx
from structlab.operators import sequence
from structlab.plans.registry import query, r6, table

FREQ = "[" + ", ".join(str(p) for p in tx.ENGLISH) + "]"
CHI = f"""list_sum(list_transform(range(1, 27), lambda k: power(len(l) - len(replace(l, chr((64 + k)::INTEGER), '')) - {FREQ}[k] / 100 * len(l), 2) / nullif({FREQ}[k] / 100 * len(l), 0)))"""


@query(f"""
    WITH t AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents WHERE lang = 'en')
    SELECT doc_id, len(l)::BIGINT AS n_letters, round({CHI} / nullif(len(l), 0), 6) + 0.0 AS chi2_per_letter FROM t
""")
def chi2_english_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'")
    n = F.length(tx.letters_only(F.col("text")))
    return docs.select("doc_id", n.cast("long").alias("n_letters"), r6(tx.chi2_english(F.col("text")) / F.nullif(n, F.lit(0))).alias("chi2_per_letter"))


@query(f"""
    WITH s AS (SELECT item_id, unnest(range(0, 26)) AS k, text FROM benchmark),
         t AS (SELECT item_id, k, upper(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ', (k + 1)::INTEGER, 26) || substr('abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz', (k + 1)::INTEGER, 26)), '[^A-Za-z]', '', 'g')) AS l FROM s),
         c AS (SELECT item_id, k, {CHI} AS chi2 FROM t)
    SELECT item_id, arg_min(k, (chi2, k))::BIGINT AS shift, round(min(chi2), 4) + 0.0 AS chi2 FROM c GROUP BY item_id
""")
def best_caesar_benchmark(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    tries = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), tx.caesar_shift(F.col("text"), k).alias("t")) for k in range(26)])).alias("s"))
    scored = tries.select("item_id", "s.k", tx.chi2_english(F.col("s.t")).alias("chi2"))
    return scored.groupBy("item_id").agg(F.min_by("k", F.struct("chi2", "k")).cast("long").alias("shift"), r6(F.min("chi2"), 4).alias("chi2"))


@query("""
    SELECT lang, count(*) AS n, round(avg(length(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')) / nullif(length(text), 0)), 6) + 0.0 AS printable,
           count(*) FILTER (regexp_full_match(text, '[\\x00-\\x7F]*')) AS n_ascii FROM documents GROUP BY lang
""")
def printable_ratio_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(
        F.count("*").alias("n"), r6(F.avg(tx.printable_ratio(F.col("text")))).alias("printable"), F.count_if(tx.is_pure_ascii(F.col("text"))).alias("n_ascii")
    )


BITS = "b AS (SELECT item_id, text, list_aggregate(list_transform(string_split(text, ''), lambda c: right(lpad(bin(ascii(c)), 32, '0'), 8)), 'string_agg', '') AS bits FROM benchmark)"


def item_bits(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tx.text_to_bits(F.col("text")).alias("bits"))


@query(f"""
    WITH {BITS}
    SELECT item_id, len(bits)::BIGINT AS n_bits, round(abs(len(replace(bits, '0', '')) / len(bits) - 0.5), 6) + 0.0 AS balance,
           round(list_sum(list_transform(range(2, len(bits) + 1), lambda i: (bits[i] <> bits[i - 1])::INT)) / (len(bits) - 1), 6) + 0.0 AS run_density FROM b
""")
def text_to_bits_stats(spark, sf_dir):
    return bits_stats(item_bits(spark, sf_dir))


def bits_stats(b):
    return b.select("item_id", F.length("bits").cast("long").alias("n_bits"), r6(tx.bit_balance(F.col("bits"))).alias("balance"), r6(tx.run_density(F.col("bits"))).alias("run_density"))


@query("""
    SELECT count(*) AS n, count(*) AS n_ok FROM benchmark WHERE regexp_full_match(text, '[\\x00-\\x7F]*')
""")
def codec_roundtrip(spark, sf_dir):
    """Encoding and decoding gives back every ASCII text."""
    return roundtrips(table(spark, sf_dir, "benchmark").select(F.col("text").alias("t")))


def roundtrips(texts):
    items = texts.filter(tx.is_pure_ascii(F.col("t")))
    return items.agg(F.count("*").alias("n"), F.count_if(tx.codec_roundtrip_ok(F.col("t")) & tx.codec_roundtrip_ok(F.col("t"), 7, False)).alias("n_ok"))


@query(f"""
    WITH {BITS}, w AS (SELECT item_id, i AS start, substr(bits, i::INTEGER, 64) AS s FROM b, LATERAL (SELECT unnest(range(1, len(bits) - 62, 16)) AS i)),
         p AS (SELECT item_id, start, len(replace(s, '0', '')) / 64.0 AS p FROM w),
         h AS (SELECT item_id, start, CASE WHEN p IN (0, 1) THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END AS h FROM p)
    SELECT item_id, count(*) AS n_windows, round(avg(h), 6) + 0.0 AS mean_h, round(min(h), 6) + 0.0 AS min_h, round(max(h), 6) + 0.0 AS max_h, count(*) FILTER (h < 0.7) AS n_low FROM h GROUP BY item_id
""")
def window_entropy_bits(spark, sf_dir):
    return window_entropy(item_bits(spark, sf_dir))


def window_entropy(b):
    profile = sequence.window_profile(b, "item_id", "bits", 64, 16)
    return profile.groupBy("item_id").agg(
        F.count("*").alias("n_windows"), r6(F.avg("entropy")).alias("mean_h"), r6(F.min("entropy")).alias("min_h"), r6(F.max("entropy")).alias("max_h"), F.count_if(F.col("entropy") < 0.7).alias("n_low")
    )


@query(f"""
    WITH {BITS}, v AS (SELECT item_id, i, CASE WHEN bits[i] = '1' THEN 1 ELSE -1 END AS v FROM b, LATERAL (SELECT unnest(range(1, len(bits) + 1)) AS i)),
         r AS (SELECT a.item_id, k, sum(a.v * b.v)::DOUBLE / count(*) AS r FROM (SELECT unnest(range(1, 33)) AS k), v a JOIN v b ON a.item_id = b.item_id AND b.i = a.i + k GROUP BY ALL)
    SELECT item_id, arg_max(k, (abs(r), -k))::BIGINT AS peak_lag, round(arg_max(r, (abs(r), -k)), 6) + 0.0 AS peak_r, count(*) FILTER (abs(r) > 0.3) AS n_strong FROM r GROUP BY item_id
""")
def autocorr_bits(spark, sf_dir):
    return autocorrelation(item_bits(spark, sf_dir))


def autocorrelation(b):
    rows = b.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("bits")), lambda i: F.when(F.substring(F.col("bits"), i, F.lit(1)) == "1", 1).otherwise(-1))).alias("i", "v"))
    w = Window.partitionBy("item_id").orderBy("i")
    shifted = rows.select("item_id", "v", *[F.lead("v", k).over(w).alias(f"l{k}") for k in range(1, 33)])
    sums = shifted.groupBy("item_id").agg(*[F.avg(F.col("v") * F.col(f"l{k}")).alias(f"r{k}") for k in range(1, 33)])
    lags = sums.select("item_id", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("r")) for k in range(1, 33)])))
    best = F.struct(F.abs("r"), -F.col("k"))
    return lags.groupBy("item_id").agg(F.max_by("k", best).cast("long").alias("peak_lag"), r6(F.max_by("r", best)).alias("peak_r"), F.count_if(F.abs("r") > 0.3).alias("n_strong"))


@query(f"""
    WITH {BITS}, n AS (SELECT item_id, bits, len(bits) AS n FROM b), d AS (SELECT item_id, bits, n, w FROM n, LATERAL (SELECT unnest(range(2, 65)) AS w) WHERE n % w = 0),
         c AS (SELECT item_id, w, (i - 1) // w AS r, avg((bits[i] = '1')::INT) AS p FROM d, LATERAL (SELECT unnest(range(1, n + 1)) AS i) GROUP BY ALL),
         h AS (SELECT item_id, w, CASE WHEN p IN (0, 1) THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END AS h FROM c)
    SELECT item_id, w::BIGINT AS width, count(*) AS n_rows, round(stddev_pop(h), 6) + 0.0 AS sd_row_entropy FROM h GROUP BY item_id, w
""")
def reshape_entropy(spark, sf_dir):
    return row_entropies(item_bits(spark, sf_dir))


def row_entropies(b):
    b = b.select("item_id", "bits", F.explode(F.sequence(F.lit(2), F.lit(64))).alias("width")).filter(F.length("bits") % F.col("width") == 0)
    starts = F.sequence(F.lit(0), F.floor(F.length("bits") / F.col("width")).cast("int") - 1)
    rows = b.select("item_id", "width", F.explode(F.transform(starts, lambda r: F.substring(F.col("bits"), r * F.col("width") + 1, F.col("width")))).alias("row"))
    h = rows.select("item_id", "width", tx.binary_entropy(tx.one_share(F.col("row"))).alias("h"))
    return h.groupBy("item_id", F.col("width").cast("long").alias("width")).agg(F.count("*").alias("n_rows"), r6(F.stddev_pop("h")).alias("sd_row_entropy"))


@query(f"""
    WITH {BITS}, o AS (SELECT item_id, bits, o FROM b, LATERAL (SELECT unnest(range(0, 8)) AS o)),
         d AS (SELECT item_id, o, m, CASE WHEN m THEN substr(bits, (o + 8 * i + 1)::INTEGER, 8) ELSE reverse(substr(bits, (o + 8 * i + 1)::INTEGER, 8)) END AS byte
               FROM o, (VALUES (true), (false)) v(m), LATERAL (SELECT unnest(range(0, (len(bits) - o) // 8)) AS i)),
         c AS (SELECT item_id, o, m, list_sum(list_transform(range(1, 9), lambda k: (byte[k] = '1')::INT * (1 << (8 - k)::INT))) AS code FROM d),
         p AS (SELECT item_id, o, m, avg((code BETWEEN 32 AND 126)::INT) AS printable FROM c GROUP BY ALL)
    SELECT item_id, arg_max(o, (printable, m, -o))::BIGINT AS skip, arg_max(m, (printable, m, -o)) AS msb_first, round(max(printable), 6) + 0.0 AS printable FROM p GROUP BY item_id
""")
def byte_decode_sweep(spark, sf_dir):
    return most_printable(item_bits(spark, sf_dir))


def most_printable(b):
    b = b.select("item_id", "bits", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("o"), F.lit([True, False]).alias("orders"))
    b = b.select("item_id", "bits", "o", F.explode("orders").alias("m"))
    n = F.floor((F.length("bits") - F.col("o")) / 8).cast("int")
    part = lambda i: F.substring(F.col("bits"), F.col("o") + i * 8 + 1, F.lit(8))
    code = lambda i: F.conv(F.when(F.col("m"), part(i)).otherwise(F.reverse(part(i))), 2, 10).cast("int")
    codes = b.select("item_id", "o", "m", F.explode(F.transform(F.sequence(F.lit(0), n - 1), code)).alias("code"))
    p = codes.groupBy("item_id", "o", "m").agg(F.avg(F.col("code").between(32, 126).cast("int")).alias("printable"))
    key = F.struct("printable", "m", -F.col("o"))
    return p.groupBy("item_id").agg(F.max_by("o", key).cast("long").alias("skip"), F.max_by("m", key).alias("msb_first"), r6(F.max("printable")).alias("printable"))


@query()
def lz76_bits(spark, sf_dir):
    return sequence.lz76_phrases(item_bits(spark, sf_dir), "item_id", "bits")


@query("""
    WITH t AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)\\s*>', ' ', 'g') AS t FROM pages)
    SELECT page_id, length(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\\s+', '', 'g'))::BIGINT AS n_chars FROM t
""")
def html_strip_stats(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)\s*>", " "), r"<[^>]+>", " ")
    return pages.select("page_id", F.length(F.regexp_replace(bare, r"[\s\x0B]+", "")).cast("long").alias("n_chars"))


_TAGS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'), '<br\s*/?>', E'\n', 'gi'), '</p\s*>', E'\n\n', 'gi'), '<[^>]+>', ' ', 'g')"


@query(rf"""
    WITH t AS (SELECT page_id, replace(replace({_TAGS}, '&nbsp;', ' '), '&amp;', '&') AS t FROM pages)
    SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g')) AS text FROM t
""")
def html_to_text_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("""
    SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._]+@[a-z0-9]+'))::BIGINT AS n_hits, regexp_extract_all(text, '[A-Za-z0-9._]+@[a-z0-9]+')[1] AS first_hit
    FROM documents WHERE contains(text, '@')
""")
def regex_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.col("text").contains("@"))
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9._]+@[a-z0-9]+"), F.lit(0))
    return docs.select("doc_id", F.size(found).cast("long").alias("n_hits"), F.get(found, F.lit(0)).alias("first_hit"))


@query("""
    WITH b AS (SELECT a.item_id AS a, b.item_id AS b, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
    SELECT a, b, list_sum(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: (x[i] <> y[i])::INT))::BIGINT AS n_diff FROM b
""")
def hamming_neighbours(spark, sf_dir):
    return differences(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t")))


def differences(items):
    pairs = items.select(F.col("item_id").alias("a"), F.col("t").alias("x")).join(items.select(F.col("item_id").alias("b"), F.col("t").alias("y")), F.col("a") + 1 == F.col("b"))
    return pairs.select("a", "b", tx.hamming(F.col("x"), F.col("y")).cast("long").alias("n_diff"))
