"""Pivots of the Jaccard join on a family of near copies whose smallest ids lie at its edge."""

import random

from structlab.llm.jaccard_join import JaccardJoin


def test_pivots_lie_in_the_middle_of_a_family(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{k}" for k in range(150)]

    def copy(i, changes):
        words = list(base)
        for at in r.sample(range(150), changes):
            words[at] = f"x{i}y{at}"
        return " ".join(words)

    # Changed words, the most in the smallest ids; none in the largest, which links every other row with up to three.
    changes = sorted((r.choice([1, 2, 3, 3, 5]) for _ in range(119)), reverse=True) + [0]
    texts = {i: copy(i, c) for i, c in enumerate(changes)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split(" ")) for i, t in texts.items())}
    want = {i: i for i in texts}
    for a in texts:  # labels spread until nothing changes
        for _ in texts:
            near = [want[b] for b in texts if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            if len({*near}) == 1:
                break
            want = {i: min(near) if c in near else c for i, c in want.items()}
    made = []
    across = JaccardJoin.across
    monkeypatch.setattr(JaccardJoin, "across", lambda self, *a: made.append((out := across(self, *a)).count()) or out)
    rows = JaccardJoin(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5, 80).run().collect()
    assert {x.row_id: x.component for x in rows} == want
    assert sum(made) < len(texts)
