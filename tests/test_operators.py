"""Known answers and negative controls."""

import json
import math

import pytest
from pyspark.sql import functions as F

from structlab.functions import dates, ratio, sphere
from structlab.functions import text as tx
from structlab.operators import fit, graph, grid, joins, nulls, periodic, plants, sequence, spatial, verdict
from structlab.sources import readers, sinks


def tokens(spark, words):
    return spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "seq long, ord long, token string")


def test_entropy_values(spark):
    flat = sequence.unigram_entropy(tokens(spark, [str(k % 8) for k in range(400)])).first()
    assert flat.entropy == pytest.approx(3) and flat.share_of_max == pytest.approx(1)
    constant = sequence.unigram_entropy(tokens(spark, ["a"] * 50)).first()
    assert constant.entropy == pytest.approx(0) and constant.ioc == 1
    alternating = sequence.conditional_entropy(sequence.bigrams(tokens(spark, ["a", "b"] * 30))).first()
    assert alternating.cond_entropy == pytest.approx(0)


def test_planted_order_beats_shuffles_and_noise_does_not(spark):
    planted = tokens(spark, ["a", "b", "c"] * 40).drop("seq")
    noise = plants.sticky_chain(spark, 1, 120, ["a", "b", "c"], 0.0, "noise").select("ord", "token")

    def z(df):
        stat = lambda d, by: sequence.conditional_entropy(sequence.bigrams(d.withColumn("seq", F.lit(0)), by), by)
        return nulls.run_null(df, stat, lambda t: nulls.permute(t, "token", ["ord"], ["trial"], "s"), "cond_entropy", 20).first()

    assert z(planted).z < -3 and z(planted).p_le == 0
    assert abs(z(noise).z) < 3.5


def test_permute_keeps_the_multiset(spark):
    df = nulls.trials(tokens(spark, list("aabbbc")), 5)
    out = nulls.permute(df, "token", ["ord"], ["trial"], "x")
    rows = out.groupBy("trial").agg(F.sort_array(F.collect_list("token")).alias("t")).collect()
    assert len(rows) == 5 and all(r.t == list("aabbbc") for r in rows)


def test_degenerate_null_is_flagged(spark):
    obs = spark.createDataFrame([(1.0,)], "v double")
    null = spark.createDataFrame([(1.0,)] * 5, "v double")
    out = nulls.summarize(obs, null, "v").first()
    assert out.null_degenerate and out.z == 0


def test_repeat_structure(spark):
    df = tokens(spark, ["r", "x", "y", "r", "p", "q", "r"])
    r = sequence.repeat_structure(df, ["seq"], "token", "ord").filter("token = 'r'").first()
    assert (r.n, r.gap_mean, r.layout) == (3, 3.0, "regular")


def test_period_recovered_and_uniform_quiet(spark):
    times = plants.arrivals(spark, 16.35, 30, 0.1, 1000.0, "a")
    best = periodic.best_period(periodic.epoch_fold(times, "t", periodic.period_grid(16.35, 3.0, 201))).first()
    assert best.z2 > 30 and abs(best.period - 16.35) < 0.1
    flat = plants.uniform_times(spark, 30, 0.0, 490.0, "b")
    assert periodic.best_period(periodic.epoch_fold(flat, "t", periodic.period_grid(16.35, 3.0, 50))).first().z2 < 18


def test_comb_and_spectrum(spark):
    peaks = plants.comb_peaks(spark, 1000.0, 2.5, 4, 20.0, 1.0)
    assert periodic.spacing_regularity(peaks, "freq").first().regular
    train = plants.periodic_train(spark, 10.0, 1.0, 100, 0.1, "t").withColumn("g", F.lit(1))
    power = periodic.power_spectrum(train, ["g"], "i", "v", 20).orderBy(F.desc("power")).first()
    assert power.k == 10
    r = {x.lag: x.r for x in periodic.autocorrelation(train, ["g"], "i", "v", 12).collect()}
    assert max((k for k in r if k > 5), key=r.get) == 10


def test_tracks(spark):
    g = {k: periodic.track_kinematics(plants.track(spark, k), ["track"], "t", "x", "y").first().max_g for k in ("ballistic", "turn", "jerk")}
    assert g["ballistic"] == pytest.approx(1, abs=0.01) and 15 < g["turn"] < 25 and g["jerk"] > 1000


def test_codecs(spark):
    df = spark.createDataFrame([("HELLO WORLD",)], "t string")
    r = df.select(
        tx.codec_roundtrip_ok(F.col("t")).alias("ok"), tx.bits_to_text(tx.text_to_bits(F.col("t"), 7), 7).alias("seven"),
        tx.caesar_shift(F.lit("Abz"), 3).alias("shift"), tx.hamming(F.lit("1010"), F.lit("0011")).alias("h"), tx.run_density(F.lit("0101")).alias("run"),
        tx.gc_content(F.lit("GGAT")).alias("gc"), tx.genome_bits(F.lit("ACGTN")).alias("bits"), tx.longest_match_tokens(F.lit("cthchx"), ["ch", "cth"]).alias("lex"),
        tx.parse_bits(F.lit("0b10 1")).alias("p"), tx.parse_bits(F.lit("12")).alias("bad"), tx.parse_j2000(F.lit("J012030-103000")).alias("j"),
        tx.html_to_text(F.lit("<script>x</script>a<br>b</p>c&amp;d")).alias("html"), tx.to_number(F.lit(" 3,5 ")).alias("num"),
        tx.snippets(F.lit("aaa key bbb key ccc"), "key", 2, 2).alias("snip"), tx.binary_entropy(F.lit(0.5)).alias("h1"),
    ).first()
    assert r.ok and r.seven == "HELLO WORLD" and r["shift"] == "Dec" and r.h == 2 and r.run == 1 and r.gc == 0.5
    assert r.bits == "00011011" and r.lex == ["cth", "ch", "x"] and r.p == "101" and r.bad is None and r.num == 3.5 and r.h1 == 1
    assert r.j.ra_deg == pytest.approx(20.125) and r.j.dec_deg == pytest.approx(-10.5)
    assert r.html == "a\nb\n\nc&d" and r.snip == ["a key b", "b key c"]


def test_sphere_and_ratios(spark):
    r = spark.range(1).select(
        sphere.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("quarter"), sphere.bearing(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)).alias("north"),
        sphere.galactic(F.lit(192.85948), F.lit(27.12825))["b"].alias("pole"), sphere.rising_azimuth(F.lit(0.0), F.lit(0.0)).alias("east"),
        sphere.rising_azimuth(F.lit(80.0), F.lit(60.0)).alias("never"), sphere.angle_delta(F.lit(350.0), F.lit(10.0)).alias("delta"), sphere.axis_delta(F.lit(5.0), F.lit(184.0)).alias("axis"),
        sphere.utm_to_lonlat(F.lit(500000.0), F.lit(4000000.0)).alias("utm"), sphere.precess(F.lit(0.0), F.lit(0.0), 2000.0, 2100.0).alias("prec"),
        ratio.nearest_diatonic(F.lit(3.0)).alias("note"), ratio.nearest_fraction(F.lit(0.6667)).alias("frac"), ratio.cents(F.lit(2.0), F.lit(1.0)).alias("cents"),
        dates.julian_day(F.lit(2000), F.lit(1), F.lit(1), 12.0).alias("jd"), dates.normalize_date(F.lit("1999-07"))["date"].cast("string").alias("date"),
        dates.lunar_illumination(F.lit("2000-01-21").cast("date")).alias("full"),
    ).first()
    assert r.quarter == pytest.approx(math.pi / 2 * 6371.0088) and r.north == pytest.approx(0) and r.pole == pytest.approx(90, abs=1e-4)
    assert r.east == pytest.approx(90) and r.never is None and r.delta == pytest.approx(20) and r.axis == pytest.approx(1)
    assert r.utm.lon == pytest.approx(-3) and r.utm.lat == pytest.approx(36.1445, abs=1e-3) and r.prec.ra_h == pytest.approx(0.0854, abs=1e-3)
    assert r.note.note == "fifth" and (r.frac.p, r.frac.q) == (2, 3) and r.cents == 1200 and r.jd == 2451545 and r.date == "1999-07-15" and r.full > 0.97


def test_clusters_and_hulls(spark):
    two = nulls.uniform_points(150, 2, (0.0, 10.0, 0.0, 10.0), "c", spark)
    clustered = two.select((F.col("trial") * 150 + F.col("i")).alias("id"), (F.col("x") + F.col("trial") * 80).alias("x"), (F.col("y") + F.col("trial") * 80).alias("y"))
    r = spatial.clark_evans(spatial.nearest_neighbours(clustered, "id", "x", "y", 2.0), 8100.0).first()
    assert r.R < 0.6 and r.z < -5
    square = spark.createDataFrame([("a", float(x), float(y)) for x in range(4) for y in range(4)], "g string, x double, y double")
    hull = spatial.convex_hull_area(square, "x", "y", ["g"]).first()
    assert (hull.n_vertices, hull.area) == (4, 9.0)
    inside = square.select(spatial.points_in_polygon(square, [(0.5, 0.5), (2.5, 0.5), (2.5, 2.5), (0.5, 2.5)], "x", "y").alias("i"))
    assert inside.filter("i").count() == 4


def test_grids(spark):
    carpet = grid.sierpinski_carpet(spark, 3).withColumn("g", F.lit(1))
    dim = grid.fractal_dimension(grid.box_counts(carpet, ["g"], [1, 3, 9]), ["g"]).first()
    assert dim.dimension == pytest.approx(math.log(8) / math.log(3), abs=1e-6)
    assert grid.best_fractal_window(grid.box_counts(carpet, ["g"], [1, 3, 9, 27]), ["g"]).first().r2 == pytest.approx(1)
    assert all(r.agreement == 1 for r in grid.symmetry(carpet, ["g"]).collect())
    small = spark.createDataFrame([(1, r, c, (r * 3 + c) % 2) for r in range(3) for c in range(3)], "g int, r int, c int, v int")
    assert grid.neighbour_agreement(small, ["g"]).first().agreement == 0
    numbered = spark.createDataFrame([(1, r, c, r * 3 + c) for r in range(3) for c in range(3)], "g int, r int, c int, v int")
    orders = {k: grid.flatten_grid(numbered, ["g"], k).first().bits for k in ("row", "col", "boustrophedon", "spiral_cw", "spiral_ccw", "row_rev")}
    assert orders == {"row": "012345678", "col": "036147258", "boustrophedon": "012543678", "spiral_cw": "012587634", "spiral_ccw": "036785214", "row_rev": "876543210"}
    lines, noise = (grid.fft_peakiness(g, ["grid"]).agg(F.avg("peakiness")).first()[0] for g in (plants.line_grid(spark, 2, 32, 4, 0.05, "l"), plants.noise_grid(spark, 2, 32, 0.3, "n")))
    assert lines > 2 * noise
    grey = spark.createDataFrame([(1, v) for v in [10] * 50 + [12] * 50 + [200] * 40], "g int, v int")
    assert grid.otsu_threshold(grey, ["g"]).first().threshold == 12
    spiral = grid.log_spiral_circles(spark, 12).withColumn("g", F.lit(1))
    assert grid.radius_sequence(spiral, ["g"], "k", "radius").first().log_spiral


def test_fits(spark):
    sky = nulls.uniform_sphere(600, 1, "sky", spark).withColumn("e", F.lit(1.0))
    x = F.cos(F.radians("dec")) * F.cos(F.radians(F.col("ra") - 90.0))
    best = fit.best_dipole(fit.dipole_grid(sky.withColumn("v", 2.0 * x + 0.5), "ra", "dec", "v", "e", 12, 6)).first()
    turned = 180 if best.amplitude < 0 else 0  # an axis has two ends
    assert abs(best.ra0 - turned - 90) <= 30 and abs(best.dec0) <= 30 and abs(best.amplitude) > 1.5
    beam = fit.best_beam(fit.beam_grid(plants.beam_samples(spark, 2.5, 1.0, 30.0), "i", "v", "gaussian", [2.0, 2.5, 3.0], [0.5, 1.0, 1.5])).first()
    assert (beam.mu, beam.sigma) == (2.5, 1.0) and beam.amplitude == pytest.approx(30)


def test_graphs_and_joins(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")], "x string, y string")
    s = graph.transition_stats(edges).first()
    assert (s.n_nodes, s.n_edges, s.reciprocity) == (3, 4, 0.5) and s.density == pytest.approx(8 / 6) and s.clustering == pytest.approx(0.5)
    weights = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 2.0), (1, "a", "c", 9.0)], "g int, a string, b string, d double")
    assert graph.spanning_tree(weights, "g").agg(F.sum("d")).first()[0] == 3
    assert graph.graph_energy(weights, "g").first().energy == pytest.approx(4)
    left = spark.createDataFrame([(1, 0, 10), (2, 25, 30)], "id long, s long, e long")
    right = spark.createDataFrame([(7, 8, 20), (8, 0, 3), (9, 30, 40)], "id long, s long, e long")
    got = [tuple(r) for r in joins.best_overlap(joins.interval_overlaps(left, right, "s", "e", 6)).collect()]
    assert got == [(1, 8, 3, True)]
    flat = spark.createDataFrame([(i, t) for i, t in enumerate("abcde")], "pos long, token string")
    lengths = spark.createDataFrame([(0, 2), (1, 3)], "word long, n long")
    words = joins.rechunk(flat, lengths).orderBy("word", "ord").groupBy("word").agg(F.array_join(F.collect_list("token"), "").alias("w"))
    assert {r.w for r in words.collect()} == {"ab", "cde"}


def test_sequence_tools(spark):
    r = spark.range(1).select(
        sequence.lz78_phrases(F.array(*[F.lit(x) for x in "abababab"])).alias("lz"), sequence.jaccard_sets(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("j"),
        tx.normalize_tokens(F.array(F.lit("a_"), F.lit("x"), F.lit("z")), {"x": "y"}, ["z"]).alias("n"), tx.is_numeral_sign(F.lit("3(N14)")).alias("num"),
    ).first()
    assert r.lz == 4 and r.j == 0.5 and r.n == ["a", "y"] and r.num
    lz76 = sequence.lz76_phrases(spark.createDataFrame([(1, "0001101001000101")], "id int, s string"), "id", "s").first()
    assert lz76.n_phrases == 6
    ties = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "x double, y double")
    assert sequence.spearman_closed(ties, "x", "y").first().rho == pytest.approx(1 - 6 * 0.5 / 24)
    assert sequence.gini(spark.createDataFrame([(1,), (1,), (1,)], "v int"), "v").first().gini == pytest.approx(0)


def test_verdicts(spark):
    df = spark.createDataFrame([(0.001, 5.0, 20, "a proof"), (0.5, 0.1, 20, "fine"), (0.001, 9.0, 3, "fine")], "p double, z double, n int, t string")
    labels = [r[0] for r in df.select(verdict.structure_verdict(F.col("p"), F.col("z"), F.col("n"))).collect()]
    assert labels == ["STRUCTURE", "NO_STRUCTURE", "UNDERDETERMINED"]
    with pytest.raises(Exception, match="forbidden phrase: proof"):
        verdict.assert_clean(df, "t", ["proof"]).collect()
    assert verdict.assert_clean(df.filter("n = 3"), "t", ["proof"]).count() == 1
    both = df.select(verdict.all_of((F.col("p") < 0.01, "LOW_P"), (F.col("z") > 4, "HIGH_Z"), none="NONE").alias("v"))
    assert [r.v for r in both.collect()] == ["LOW_P | HIGH_Z", "NONE", "LOW_P | HIGH_Z"]


def test_readers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    corpus = put("c.json", json.dumps({"sequences": {"s1": ["a", None, "b"], "s2": []}}))
    assert [(r.seq, r.ord, r.token) for r in readers.sequence_map(spark, corpus).collect()] == [("s1", 0, "a"), ("s1", 2, "b")]
    assert readers.read_or(spark, str(tmp_path / "none.json"), readers.sequence_map, lambda: spark.range(1))[1] == "fallback"
    nested = put("w.json", json.dumps({"words": [["a", "b"], ["c"]]}))
    assert readers.word_lists(spark, nested).count() == 3
    sites = put("s.json", json.dumps({"f": {"sites": {"x": {"sequences": [["a"], ["b", "c"]]}}}}))
    assert readers.site_sequences(spark, sites, "f").count() == 3
    atf = put("t.atf", "&P1 = x\n@tablet\n1. 3(N14) , KUR#? {d}AN\n# note\n")
    assert [r.token for r in readers.atf(spark, atf).collect()] == ["3(N14)", "KUR", "AN"]
    voynich = put("v.txt", "# c\n<f1r>  <! $Q=A>\n<f1r.1,@P0>  fachys.ykal.[a:o]r,{x}dy\n")
    got = readers.ivtff(spark, voynich).collect()
    assert [r.token for r in got][-4:] == ["fachys", "ykal", "ar", "dy"] and got[-1].folio == "f1r"
    fa = put("g.fa", ">one\nacgt\nAC\n>two\nGG\n")
    assert [(r.label, r.seq) for r in readers.fasta(spark, fa).collect()] == [("one", "ACGTAC"), ("two", "GG")]
    bed = put("r.bed", "# c\nchr\t0\t265\tutr\nchr\t265\t4000\tcds\n")
    assert readers.bed4(spark, bed).count() == 2
    with pytest.raises(Exception, match="bad BED4 row"):
        readers.bed4(spark, put("bad.bed", "chr\t9\t3\tutr\n")).collect()
    dat = put("m.dat", "# h\n1.5 2 x\nbad row\n3 4 y\n")
    assert [(r.a, r.b) for r in readers.space_table(spark, dat, [("a", "double"), ("b", "double"), ("c", "string")]).collect()] == [(1.5, 2.0), (3.0, 4.0)]
    table = put("b.csv", "TNS_Name,MJD\nfrb1,\"58000,5\"\n,3\nfrb2,x\n")
    schema = {"name": (["tns_name"], "string"), "mjd": (["time"], "double")}
    assert [tuple(r) for r in readers.alias_csv(spark, table, schema, ["name", "mjd"]).collect()] == [("frb1", 58000.5)]
    assert readers.alias_csv(spark, table, schema | {"ra": ([], "double")}, ["ra"]).count() == 0
    geo = put("g.json", json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"n": "x"}}, {"geometry": {"type": "Line", "coordinates": [[1, 2]]}, "properties": {}}]}))
    assert [(r.lon, r.lat) for r in readers.geojson_points(spark, geo).collect()] == [(1.0, 2.0)]
    rows = readers.split_rows(spark.createDataFrame([("s", i, t) for i, t in enumerate("ab|c")], "seq string, ord int, token string"), "|")
    assert {(r.seq, r.token) for r in rows.collect()} == {("s/0", "a"), ("s/0", "b"), ("s/1", "c")}
    sinks.write_feature_table(spark.range(2), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert sinks.report(spark.range(1).select(F.lit(2.5).alias("m")), "p").first().value == 2.5
    assert "| id |" in sinks.markdown(spark.range(1), "t")


def test_streams(spark, tmp_path):
    from structlab.streaming import events as st

    rows = spark.range(50).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7 as int))").alias("ts"), (F.col("id") % 3).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: st.event_stream(spark, str(tmp_path / "events.parquet"))
    hours = st.run_to_table(st.tumbling(stream()), "t1", "complete", str(tmp_path / "c1"))
    assert hours.agg(F.sum("n")).first()[0] == 50
    assert st.run_to_table(st.sliding(stream()), "t2", "complete", str(tmp_path / "c2")).agg(F.sum("n")).first()[0] == 100
    assert st.run_to_table(st.sessions(stream(), "30 minutes"), "t3", "complete", str(tmp_path / "c3")).count() == 3
    assert st.run_to_table(st.running_phase(stream(), 3600.0), "t4", "complete", str(tmp_path / "c4")).first().n == 50
    assert st.run_to_parquet(st.deduplicated(stream()), str(tmp_path / "o"), str(tmp_path / "c5")).count() == 50


def test_repeat_structure_on_a_limit_follows_the_running_deviation(spark):
    import random

    def deviations(gaps):
        n, mean, one, other, squares = 0, 0.0, 0.0, 0.0, 0.0
        for x in gaps:
            n += 1
            new = mean + (x - mean) / n
            one += (x - new) * (x - mean)  # as DuckDB sums it
            squares += (x - mean) * ((x - mean) - (x - mean) / n)  # as Spark does
            mean = new
        return math.sqrt(one / n), math.sqrt(squares / n), sum(gaps) / n

    r, rows, want = random.Random(2), [], {}
    while len(want) < 12:
        gaps = [r.choice([1, 1, 2, 3, 5, 8, 13, 21]) for _ in range(r.randint(5, 17))]
        if len(gaps) * sum(g * g for g in gaps) != 2 * sum(gaps) ** 2:
            continue
        one, other, mean = deviations(gaps)
        if (one / mean >= 1) != (other / mean >= 1):
            seq = len(want)
            want[seq] = "clustered" if one / mean >= 1 else "scattered"
            rows += [(seq, "r", sum(gaps[:k])) for k in range(len(gaps) + 1)]
    df = spark.createDataFrame(rows, "seq int, token string, ord int")
    got = {x.seq: x.layout for x in sequence.repeat_structure(df, ["seq"], "token", "ord").collect()}
    assert set(want.values()) == {"clustered", "scattered"} and got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drawn_rows_are_never_broadcast(spark):
    df = spark.range(300).select((F.col("id") % 5).alias("u"), F.col("id").alias("pos"), F.col("id").alias("v"))
    plan = plan_of(nulls.bootstrap(df, "v", ["pos"], ["u"], "t", 30))
    assert "SortMergeJoin [__rn" in plan


def test_exploded_cells_are_never_broadcast(spark):
    df = spark.range(300).select("id", (F.col("id") * 1.1).alias("x"), (F.col("id") * 0.2).alias("y"))
    for pairs in (spatial.sky_neighbours(df, "id", "x", "y", 2.0), spatial.close_pairs(df, "id", "x", "y", 2.0)):
        assert "SortMergeJoin" in plan_of(pairs) and "BroadcastHashJoin" not in plan_of(pairs)


def test_nearest_points_begin_with_cells_of_few_points(spark, monkeypatch):
    widths, search = [], spatial.nearest_by_doubling
    monkeypatch.setattr(spatial, "nearest_by_doubling", lambda *a: widths.append(a[4]) or search(*a))
    df = spark.range(900).select("id", (F.col("id") % 30).alias("x"), F.floor(F.col("id") / 30).alias("y"))
    assert spatial.nearest_neighbours(df, "id", "x", "y", 60.0).filter("nn = 1").count() == 900
    assert len(widths) == 1 and 0 < widths[0] <= 2.0


def test_deduplicated_stream_leaves_no_rows_in_memory(spark):
    from structlab import plans

    path = "/root/testdata/sf0.001"
    n = plans.QUERIES["stream_deduplicated"](spark, path).agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet(f"{path}/events.parquet").select("event_id").distinct().count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("dedup_")]


def test_files_hold_many_buckets(spark):
    """A file holds a fixed number of buckets, in order: 200 buckets of lines or documents take four files."""
    import glob

    from structlab.plans import roundtrips

    rows = spark.range(20_000).select(roundtrips.bucket("id"), F.col("id").alias("place"), F.concat_ws("\t", F.lit("c"), "id", F.col("id") + 1, F.lit("utr")).alias("value"))
    path = roundtrips.put(rows, "lines")
    assert len(glob.glob(f"{path}/file=*/*.txt")) == 4
    got = readers.bed4(spark, path)
    assert got.count() == got.select("start").distinct().count() == 20_000
    first = spark.read.text(path, wholetext=True).filter("file = 1").first().value.splitlines()
    assert [int(r.split("\t")[1]) for r in first] == list(range(6400, 12800))
    docs = spark.range(200).select(F.col("id").alias("bucket"), F.to_json(F.struct(F.array(F.array(F.col("id").cast("string"))).alias("words"))).alias("value"))
    path = roundtrips.put(docs, "docs")
    assert len(glob.glob(f"{path}/file=*/*.txt")) == 4
    assert sorted(int(r.token) for r in readers.word_lists(spark, path).collect()) == list(range(200))
