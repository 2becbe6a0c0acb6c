"""The bundle source over generated files: order of sources, shapes of records, named errors, one partition per file."""

import json

import pytest

from structlab.sources import bundles


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_sequences_of_all_shapes(spark, tmp_path):
    d = tmp_path / "b"
    d.mkdir()
    put(d / "a.json", [{"cdli_id": "P1", "tokens": ["x", None, "y"], "script_genre": "ledger"}, {"atf": "&P2 = t\n@tablet\n1. |M1| M2 , 3(N01)\n2. M4 # note\n$ broken"}])
    put(d / "b.json", {"tablets": [{"cdli_id": 7, "tokens": []}, {"cdli_id": "P8"}, "text"]})
    put(d / "c.json", {"formulaic": [{"cdli_id": "F", "tokens": ["a", "b"]}], "narrative": [{"cdli_id": "N", "tokens": ["c"]}], "note": "n"})
    put(d / "d.json", {"cdli_id": "alone", "tokens": ["q"]})
    put(d / "e.json", "[1, 2")
    put(d / "f.json", "")
    df, provenance = bundles.read_bundle(spark, "sequences", bundle=str(d))
    rows = df.collect()
    assert provenance == "USER_OVERRIDE" and df.rdd.getNumPartitions() == 5
    bad = {(r.file[-6:], r.record): (r.error, r.provenance) for r in rows if r.error}
    assert bad == {
        ("b.json", 1): ("record 1: neither atf nor a list of tokens", "USER_OVERRIDE_INVALID"),
        ("b.json", 2): ("record 2: str in place of an object", "USER_OVERRIDE_INVALID"),
        ("e.json", 0): ("not JSON: Expecting ',' delimiter at 5", "USER_OVERRIDE_INVALID"),
    }
    tokens = {}
    for r in bundles.bundled_tokens(spark, bundle=str(d)).collect():
        tokens.setdefault((r.file[-6:], r.seq), []).append((r.ord, r.token))
    words = {k: [t for _, t in sorted(v)] for k, v in tokens.items()}
    assert words == {("a.json", "P1/0"): ["x", "y"], ("a.json", "?/1"): ["|M1|", "M2", "3(N01)", "M4"], ("c.json", "F/0"): ["a", "b"], ("c.json", "N/1"): ["c"], ("d.json", "alone/0"): ["q"]}


def test_times(spark, tmp_path):
    flat, named = put(tmp_path / "flat.json", [58700.5, 58717, 1e3]), put(tmp_path / "named.json", [{"name": "F", "mjd": 5.0}, {"mjd": 6}, {"mjd": "x"}])
    mixed, top = put(tmp_path / "mixed.json", [1.0, {"mjd": 2.0}]), put(tmp_path / "top.json", {"mjd": 2.0})
    got = lambda path: sorted((r.record, r.name, r.t, r.error) for r in bundles.read_bundle(spark, "times", bundle=path)[0].collect())
    assert got(flat) == [(0, None, 58700.5, None), (1, None, 58717.0, None), (2, None, 1000.0, None)]
    assert got(named) == [(0, "F", 5.0, None), (1, None, 6.0, None), (2, None, None, "record 2: mjd is no number")]
    assert got(mixed) == [(1, None, None, "record 1: neither all numbers nor all objects with mjd")]
    assert got(top) == [(0, None, None, "top level: dict in place of a list")]
    for path in (mixed, top):
        with pytest.raises(Exception, match="in place of a list|neither all numbers"):
            bundles.read_bundle(spark, "times", bundle=path, on_error="raise")[0].collect()


def test_order_of_sources(spark, tmp_path):
    cache = put(tmp_path / "cache.csv", "TNS_Name , peak_mjd,x\nFRB1,5.5,a\nFRB1,bad,b\n,7,c\nFRB2,9,d\n")
    bundle = put(tmp_path / "bundle.csv", "source,mjd\nB,1\n")
    rows, word = bundles.read_bundle(spark, "bursts", cache=cache, bundle=bundle)
    assert word == "CACHED" and sorted((r.name, r.t, r.provenance) for r in rows.collect() if r.t is not None) == [("FRB1", 5.5, "CACHED"), ("FRB2", 9.0, "CACHED")]
    assert rows.count() == 3
    rows, word = bundles.read_bundle(spark, "bursts", cache=str(tmp_path / "none.csv"), bundle=bundle)
    assert word == "USER_OVERRIDE" and [(r.name, r.t) for r in rows.collect()] == [("B", 1.0)]
    rows, word = bundles.read_bundle(spark, "bursts", hook="UNREACHABLE", cache=cache, bundle=bundle)
    assert word == "UNREACHABLE" and rows.count() == 0
    rows, word = bundles.read_bundle(spark, "bursts", cache=str(tmp_path / "none.csv"))
    assert word == "EMPTY" and rows.columns == ["name", "t", "file", "record", "error", "provenance"] and rows.count() == 0
    odd, _ = bundles.read_bundle(spark, "bursts", bundle=put(tmp_path / "odd.csv", "a,mjd\nq,1\n"))
    assert [r.error for r in odd.collect()] == ["header: no column for the name"]
