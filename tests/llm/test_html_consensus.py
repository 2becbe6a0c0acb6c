"""Main text by consensus against a plain version of scores and votes, on deep pages and on article text with suspicious class names."""

import time
from collections import Counter

import pytest

from structlab.llm import html_consensus as hc

MENU = '<div class="nav-bar"><a href="/">Home</a> <a href="/x">Other stories to read</a></div>'
TAIL = '<div class="comments"><p>I disagree with all of this text</p></div><div id="cookie-notice">We use cookies here</div>'


def page(k, extra=""):
    return f'<html><body>{MENU}<div class="story s{k}"><p>First words of article {k} are here.</p>{extra}<p>And more of it follows, number {k}.</p></div>{TAIL}</body></html>'


def plain_scores(p):
    """Each block walks up all of its containers, whose paths are whole strings."""
    out = Counter()
    for c, text, linked in p.blocks:
        depth = 0
        while c >= 0:
            weight = {"article": 1.5, "main": 1.2, "body": 0.5}.get(p.steps[c][-1].split(".")[0], 1.0)
            out[hc.path_of(p, c)] += (len(text) - 2.0 * linked) * weight * 0.8**depth
            c, depth = p.parents[c], depth + 1
    return out


@pytest.mark.parametrize(
    "extra,kept",
    [
        ('<div class="header-image"><p>Lead paragraph.</p></div>', ["Lead paragraph."]),
        ('<div class="related-text">Told at length.</div>', ["Told at length."]),
        ('<p class="comment-ary">A word.</p>', ["A word."]),
        ('<div class="ad-box">Buy this</div><div class="social share">Post it</div><div id="comment_list">No</div><div role="complementary">No</div>', []),
        ('<div class="related-posts"><a href="/">Read on</a></div><aside>No</aside><div hidden>No</div>', []),
    ],
)
def test_article_text_stays(extra, kept):
    p = hc.parse(page(1, extra))
    assert hc.text_under(p, None).split("\n") == ["First words of article 1 are here.", *kept, "And more of it follows, number 1."]


def test_scores_and_winners_are_the_plain_ones(spark):
    pages = [(k, f"http://h{k % 3}.example/{k}", page(k)) for k in range(12)]
    pages[4] = (4, pages[4][1], "<body><main><div class=x><p>Long text of another kind of page, long enough.</p></div></main></body>")
    pages += [(20, "http://h0.example/q", None), (21, None, "<p>only text"), (22, "http://h1.example/z", "<td>" * 40 + "deep</p></div>" * 3)]
    votes = {}
    for _, url, html in pages:
        p = hc.parse(html)
        want = plain_scores(p)
        keys = hc.keys_of(p)
        got = hc.scores(p, keys)
        assert {hc.path_of(p, c): pytest.approx(want.get(hc.path_of(p, c), 0.0)) for c in range(len(keys))} == {hc.path_of(p, c): got[k] for c, k in enumerate(keys)}
        if want and p.blocks:
            host = (url or "").split("/")[2] if url else ""
            top = max(want.values())
            votes.setdefault(host, Counter())[min(x for x, v in want.items() if v == pytest.approx(top))] += 1
    winners = {h: max(v.items(), key=lambda kv: (kv[1], kv[0]))[0] for h, v in votes.items()}
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert {r.host: r.path for r in hc.winning_paths(hc.votes(df)).collect()} == winners
    for bound in (hc.HOST_BOUND, 0):
        got = {r.row_id: r.text for r in hc.extract_main_text(df, host_bound=bound).collect()}
        assert got[0] == "First words of article 0 are here.\nAnd more of it follows, number 0."
        assert got[4].startswith("Long text") and got[20] == "" and got[21] == "only text" and "deep" in got[22]


def test_deep_pages_cost_their_length():
    began = time.time()
    for d in ("<div>", '<div class="a"><p>', "<section><ul><li>"):
        p = hc.parse(d * 20_000 + "the text at the bottom")
        assert hc.text_under(p, None) == "the text at the bottom"
    assert time.time() - began < 6
