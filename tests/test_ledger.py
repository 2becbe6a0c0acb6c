"""Invariants of accounting tablets: a planted ledger passes all four, a text without order fails."""

import random

from structlab.operators import ledger


def test_ledger_and_narrative(spark):
    r = random.Random(3)
    rows = []
    for t in range(40):
        ord_ = 0
        for s in range(4):
            rows.append(("ledger", t, ord_, f"H{r.randint(1, 5)}", False))
            ord_ += 1
        number = r.randint(1, 6)
        for _ in range(8):
            if r.random() > 0.85:
                number = r.randint(1, 6)
            for token, num in ((f"{number}(N01)", True), (f"C{r.randint(1, 3)}", False)):
                rows.append(("ledger", t, ord_, token, num))
                ord_ += 1
        for k in range(15):
            rows.append(("text", t, k, r.choice("abcdefg"), False))
        for k in range(20):
            rows.append(("noise", t, k, *r.choice([(f"{n}(N01)", True) for n in range(1, 7)] + [("x", False)] * 6)))
    df = spark.createDataFrame(rows, "corpus string, t int, i int, token string, num boolean").repartition(3)
    judged = ledger.ledger_invariants(ledger.ledger_statistics(df, "corpus", ["t"], ["i"], "token", "num", 10, "s"))
    out = {x.corpus: x for x in judged.collect()}
    a, b, c = out["ledger"], out["text"], out["noise"]
    assert a.all_hold and (a.n_header, a.n_header_numerals, a.n_lines, a.n_numerals) == (160, 0, 640, 320)
    assert not b.all_hold and b.n_lines == 0 and not b.header_bounded and b.z == 0 and b.ratio == 0
    assert not c.all_hold and c.n_header_numerals == 0 and not c.numerals_predictable and abs(c.z) < 4
    diff = {x.corpus: x for x in ledger.compare_ledgers(judged, "ledger").collect()}
    assert set(diff) == {"text", "noise"} and diff["noise"].h2_diff > 0.5 and diff["noise"].n_alike == sum(a[i] == c[i] for i in ledger.INVARIANTS)
