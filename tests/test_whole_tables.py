"""Queries read whole tables and whole texts, as their SQL does: ids and texts are stretched, so that a cut would show."""

import math
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from structlab import plans
from structlab.operators import spatial
from structlab.plans import space

SF = "/root/testdata/sf0.001"
TABLES = "nation customer supplier orders lineitem events benchmark".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Larger ids and longer texts.
STRETCHED = {
    "customer": "SELECT * REPLACE (c_custkey * 2 AS c_custkey) FROM t",
    "events": "SELECT * REPLACE (user_id * 2 AS user_id) FROM t",
    "supplier": "SELECT * REPLACE (s_suppkey * 20 AS s_suppkey) FROM t",
    "benchmark": "SELECT * REPLACE (text || ' ' || reverse(text) AS text) FROM t",
}
#: Queries that once took a part of their tables or texts.
WHOLE = [
    "interval_overlap_bins",
    "lunar_illumination_orders",
    "julian_day_orders",
    "stratified_bootstrap_null",
    "entropy_vs_uniform",
    "haversine_nn",
    "sky_close_pairs",
    "collinear_triples",
    "pairwise_ratio_diatonic",
    "beam_transit_fit",
    "codec_roundtrip",
    "hamming_neighbours",
    "lz78_benchmark",
    "text_to_bits_stats",
    "window_entropy_bits",
    "autocorr_bits",
    "reshape_entropy",
    "byte_decode_sweep",
]


@pytest.fixture(scope="module")
def stretched(tmp_path_factory):
    root, con = tmp_path_factory.mktemp("whole"), duckdb.connect()
    for t in TABLES:
        made = STRETCHED.get(t, "SELECT * FROM t").replace("FROM t", f"FROM '{SF}/{t}.parquet'")
        con.execute(f"COPY ({made}) TO '{root}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return str(root), con


def in_order(rows):
    return sorted(rows, key=lambda r: ([repr(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]))


def same(x, y):
    """Equal, but for the order of summation in the last of six places."""
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1.5e-6) if isinstance(x, float) and isinstance(y, float) else repr(x) == repr(y)


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_query(spark, stretched, name):
    root, con = stretched
    df = plans.QUERIES[name](spark, root)
    columns = sorted(df.columns)
    got = in_order(tuple(r) for r in df.select(*columns).collect())
    out = con.execute(plans.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = in_order(tuple(r[names.index(c)] for c in columns) for r in out.fetchall())
    assert len(got) == len(want) and all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_collinear_triples_in_blocks(spark, stretched):
    rows = space.sites(spark, stretched[0]).withColumn("nation", space.F.col("id") % 4)
    key = lambda df: sorted(df.select("nation", "tol", "n_triples", "mean_dev").collect())
    want = key(spatial.collinear_triples(rows, "id", "lat", "lon", [1.0, 5.0], ["nation"]))
    for block, piece in ((32, 250_000), (5, 300), (1, 1)):
        got = key(spatial.collinear_triples_whole(rows, "id", "lat", "lon", [1.0, 5.0], ["nation"], block, piece))
        assert len(want) == 4 and [r[:3] for r in got] == [r[:3] for r in want]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-9)


def test_collinear_triples_on_a_tolerance(spark):
    """Deviations that lie on a tolerance to the last bits are judged in degrees, as the plain version does."""
    places = [(10.0, 20.0 + 3 * k) if k % 3 else (-40.0 + 4 * k, 20.0) for k in range(24)]
    rows = spark.createDataFrame([(k, 0, la, lo) for k, (la, lo) in enumerate(places)], "id long, g int, lat double, lon double")
    key = lambda df: sorted(df.select("tol", "n_triples", "mean_dev").collect())
    devs = [1e-9, 0.25, 5.0, 60.0, 90.0]
    want, got = key(spatial.collinear_triples(rows, "id", "lat", "lon", devs, ["g"])), key(spatial.collinear_triples_whole(rows, "id", "lat", "lon", devs, ["g"], 7, 40))
    assert [r[:2] for r in got] == [r[:2] for r in want] and 0 < want[0][1] < want[2][1] < want[4][1] == 24 * 23 * 22 // 6
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-7)


def test_collinear_triples_of_a_large_group(spark):
    """562 million triples of one group: each once, and a few nanoseconds apiece (the whole took about half a minute before)."""
    rows = spark.range(1500).select("id", F.lit(0).alias("g"), (F.rand(1) * 120 - 60).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    spatial.collinear_triples_whole(rows.limit(3), "id", "lat", "lon", [180.0], ["g"]).collect()
    began = time.perf_counter()
    (row,) = spatial.collinear_triples_whole(rows, "id", "lat", "lon", [180.0], ["g"]).collect()
    assert row.n_triples == 1500 * 1499 * 1498 // 6
    assert time.perf_counter() - began < 20


def test_embedding_nn_in_blocks_of_queries(spark, monkeypatch):
    """However large the table is, queries are broadcast, in blocks; none is lost and no product is shuffled."""
    from structlab.plans import relational

    want = sorted(plans.QUERIES["embedding_nn"](spark, SF).collect())
    monkeypatch.setattr(relational, "QUERY_BLOCK", 2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = plans.QUERIES["embedding_nn"](spark, SF)
        assert "CartesianProduct" not in df._jdf.queryExecution().toString()
        assert sorted(df.collect()) == want and len(want) > 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_sky_nearest_finds_lone_points(spark, stretched):
    rows = space.sites(spark, stretched[0])
    nn = lambda t: {r.id: r.nn for r in spatial.sky_nearest(rows, "id", "lon", "lat", t, ["nation"]).collect()}
    assert nn(3.0) == nn(60.0) and len(nn(3.0)) == 150


def test_lz76_reads_whole_texts(spark, stretched):
    def phrases(s):
        i, k = 0, 0
        while i < len(s):
            n = 1
            while i + n <= len(s) and s[i : i + n] in s[: i + n - 1]:
                n += 1
            i, k = i + n, k + 1
        return k

    root, con = stretched
    got = {r.item_id: r.n_phrases for r in plans.QUERIES["lz76_bits"](spark, root).collect()}
    texts = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert got == {k: phrases("".join(format(ord(c) & 255, "08b") for c in t)) for k, t in texts}


def test_scrambled_beam_null_adds_in_order(spark, tmp_path):
    """Samples dealt in order, or reversed, tie but for the last bits: rows are those of the SQL, added in one thread."""
    import duckdb

    base = [346, 421, 478, 760, 1218]  # users with such ties among their copies
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").filter(space.F.col("user_id").isin(base))
    copies = events.withColumn("k", space.F.explode(space.F.sequence(space.F.lit(0), space.F.lit(59))))
    copies = copies.withColumn("user_id", space.F.expr("user_id + 1500 * k")).withColumn("event_id", space.F.expr("event_id + 100000 * k")).drop("k")
    copies.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(plans.ORACLES["scrambled_beam_null"]).fetchall())
    got = sorted(tuple(r) for r in plans.QUERIES["scrambled_beam_null"](spark, str(tmp_path)).collect())
    assert len(want) == 300 and got == want


def test_embedding_nn_makes_no_row_per_pair(spark, tmp_path):
    """Rows reach the aggregate as a task's best of each query; odd vectors (gaps, NaN, NULL, other lengths) count as in the SQL."""
    import duckdb

    nan = float("nan")
    vectors = [[float((k * 7 + c * 13) % 11) - (k % 3) * 0.1 for c in range(8)] for k in range(3000)]
    odd = {5: None, 6: [], 7: [1.0], 8: [None] * 8, 9: [nan] * 8, 10: [float("inf")] * 8, 11: [3.0, None, 2.5], 100: None, 200: [1.0, None], 300: [nan] * 8, 400: vectors[401], 402: vectors[401], 500: [2.0] * 9}
    rows = [(k, odd.get(k, v)) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = plans.QUERIES["embedding_nn"](spark, str(tmp_path))
    assert "NestedLoopJoin" not in df._jdf.queryExecution().toString()
    want, got = (sorted(map(str, map(tuple, r))) for r in (con.execute(plans.ORACLES["embedding_nn"]).fetchall(), df.collect()))
    assert len(want) == 30 and got == want


def test_configuration_null_keeps_no_random_graph(spark, monkeypatch):
    """Graphs that are made one after another are those made at once, and of each only its row stays on the disk."""
    from structlab import shared
    from structlab.plans import nullmodels

    before = set(shared._SETTLED)
    run = lambda: sorted(tuple(r[c] for c in ("trial", "n_edges", "n_loops", "n_repeats", "n_degrees_moved", "degree_products")) for r in plans.QUERIES["configuration_null"](spark, SF).collect())
    at_once = run()
    left = [spark.read.parquet(p).count() for p in shared._SETTLED if p not in before]
    n_edges = at_once[0][1]
    assert sum(n >= n_edges for n in left) == 1 and len(left) <= 4, left
    monkeypatch.setattr(nullmodels, "TOGETHER", 1)
    assert run() == at_once and [r[0] for r in at_once] == [-1, 0, 1, 2]
