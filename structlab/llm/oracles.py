"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

from structlab.llm.source_mix import DRAWS

WORDS = r"'[^\x20\x09-\x0D]+'"

_UNIFORMS = ", ".join(
    f"('0x' || substr(md5('mix{k - k % 4}|' || coalesce(doc_id::VARCHAR, 'null')), {1 + 8 * (k % 4)}, 8))::BIGINT / 4294967296.0::DOUBLE" for k in range(DRAWS)
)

OP7 = f"""
    WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents),
         z AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s GROUP BY source),
         w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][k % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM z),
         o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
                      sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
                      sum(source_size) OVER () * 1.5::DOUBLE AS goal, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
         l AS (SELECT *, (goal - cap_before) / weight_left AS level FROM o),
         f AS (SELECT arg_min(level, place) AS final FROM l WHERE level * weight < cap),
         t AS (SELECT source, source_size, least(cap, coalesce(final * weight, cap)) AS target FROM l, f),
         r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(target / source_size, 2.0) END AS rate FROM t),
         u AS (SELECT s.*, r.source_size, r.target, r.rate, rate - floor(rate) AS part, [{_UNIFORMS}] AS u FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source),
         d AS (SELECT source, k, abs(coalesce(sum(size) FILTER (u[k] < part), 0) - any_value(part * source_size)) AS off FROM u, (SELECT unnest(range(1, {DRAWS + 1})) AS k) GROUP BY source, k),
         b AS (SELECT source, arg_min(k, (off, k)) AS draw FROM d GROUP BY source)
    SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u[draw] < part)::INT))::BIGINT AS taken FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source
"""

OP6 = f"""
    WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS t FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 2], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(t) - 1, 2))) AS i) WHERE len(t) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
    r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
    SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP8 = """
    SELECT doc_id,
           max(doc_id) OVER g AS keep_id,
           count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RULES = (
    ("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]{12,}"), ("hex", "[0-9a-f]{32,}"), ("private_key", "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("repo_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
)
_SCANS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {place} AS place, string_split_regex(coalesce(text, ''), '{pattern}') AS g, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m FROM documents"
    for place, (kind, pattern) in enumerate(_RULES)
)

OP10 = f"""
    WITH s AS ({_SCANS}), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM s),
         p AS (SELECT doc_id, kind, place, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, m[i] AS found FROM i),
         k AS (SELECT doc_id, kind, place, a, kind || ':' || a || ':' || (a + length(found)) AS span FROM p WHERE kind <> 'assign' OR length(regexp_extract(found, '{_ASSIGN}', 2)) >= 8),
         d AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
                      coalesce(string_agg(span, ',' ORDER BY a, place) FILTER (place < 3), '') AS base, string_agg(span, ',' ORDER BY a, place) AS spans FROM k GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents t LEFT JOIN d ON d.doc_id = t.doc_id
"""

OP12 = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
         s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
               FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
         p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
         n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
                      s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
               FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT * FROM n WHERE rank <= 10
"""

#: The register's step for each low byte, and the CRC-32 of a word's bytes.
_STEPS = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP13 = f"""
    WITH t AS (SELECT {_STEPS} AS step),
         b AS (SELECT doc_id, true AS source, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
         f AS (SELECT doc_id, source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_LETTERS})) AS word FROM b),
         d AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM f),
         c AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
                      lambda r, x: xor(step[(xor(r, x) & 255) + 1], r >> 8)), 4294967295) % 10000 AS bucket FROM d, t),
         u AS (SELECT bucket, count(*) FILTER (source) AS s, count(*) FILTER (NOT source) AS t FROM f JOIN c USING (word) GROUP BY bucket),
         a AS (SELECT coalesce(sum(s), 0)::BIGINT AS s, coalesce(sum(t), 0)::BIGINT AS t FROM u),
         g AS (SELECT bucket, floor(1000 * ln(((u.t + 1)::DOUBLE * (a.s + 10000)) / ((u.s + 1)::DOUBLE * (a.t + 10000))))::BIGINT AS gain FROM u, a),
         w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN c USING (word) JOIN g USING (bucket) WHERE source GROUP BY doc_id),
         z AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
                      ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
         y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM z),
         r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM y)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM r
"""

ORACLES = {"op6_jaccard_join": OP6, "op7_source_mix": OP7, "op8_exact_dedup": OP8, "op10_secret_ledger": OP10, "op12_vector_file": OP12, "op13_target_resample": OP13}
