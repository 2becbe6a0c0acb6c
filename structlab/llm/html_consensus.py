"""Main text of web pages by consensus of their host.

Each page scores its containers; the generalised tag-class paths of the best
ones are voted on per host in Spark, and pages are extracted again under the
path that won.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlab.llm.common import Scratch, bounded

#: Most hosts whose winning path is broadcast.
HOST_BOUND = 200_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never main text.
DROPPED = frozenset(
    "nav footer aside form script style noscript template svg math iframe object button select textarea option dialog head title canvas audio video map menu fieldset label".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div body td".split())
#: Elements that end an open paragraph.
CLOSES_P = BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
#: Words of a class, id or role that mark what is not the article, and words that only say how it is built.
NOISE = re.compile(
    r"ad|ads|adv|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|sidebar|side|aside|nav|navbar|navigation|navi|menu|breadcrumbs?|"
    r"footer|foot|masthead|topbar|header|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notices?|alert|"
    r"newsletter|subscribe|signup|login|popup|modal|overlay|share|sharing|social|related|recommended|widget|pagination|pager|"
    r"complementary|contentinfo|search"
)
BUILT = re.compile(
    r"\d*|area|articles?|bar|block|body|bottom|box|buttons?|column|container|content|float\w*|for|form|global|group|head|icons?|inner|items?|js|left|link|links|list|listing|local|main|"
    r"message|more|outer|page|pane|panel|posts?|primary|reader|right|row|secondary|section|site|slot|stories|thread|title|top|ui|unit|user|wrap|wrapper|the|your|us|me|to|of|by|and|in|up|l|r|x|s|m|xs|sm|md|lg|xl|v"
)


def names_noise(name: str) -> bool:
    """Whether a name speaks of noise and, but for how it is built, of nothing else: ``ad-box`` and ``comment_list`` do, ``header-image`` doesn't."""
    parts = re.split(r"[_-]", name)
    noisy = [bool(NOISE.fullmatch(p)) for p in parts]
    return any(noisy) and all(n or BUILT.fullmatch(p) for n, p in zip(noisy, parts, strict=True))


def general(tag: str, attrs: dict) -> str:
    """A step of a path: the tag and its classes, digits taken out."""
    names = sorted({re.sub(r"\d+", "#", c.lower()) for c in (attrs.get("class") or "").split()})
    return tag + "".join(f".{n}" for n in names)


def is_noise(tag: str, attrs: dict, inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(names_noise(name) for k in ("class", "id", "role") for name in (attrs.get(k) or "").lower().split())


class Blocks(HTMLParser):
    """Blocks of a page in order: (innermost container or -1, text, characters of it in links).

    A container is known by its parent and its last step, so a page costs time
    in proportion to its length however deep it is.  Markup may be broken: a
    paragraph ends where a block begins, an end tag closes what stands above
    its start, and unknown end tags are passed over.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, whether it starts noise, whether it is a container
        self.count: Counter[str] = Counter()
        self.noise, self.links, self.articles = 0, 0, 0
        self.steps: list[list[str]] = []  # of each container, from its parent on
        self.parents: list[int] = []
        self.around: list[int] = []
        self.between: list[list[str]] = [[]]  # steps since the innermost container
        self.buffer: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[int, str, int]] = []

    def flush(self) -> None:
        if self.buffer:
            if text := " ".join("".join(self.buffer).split()):
                self.blocks.append((self.around[-1] if self.around else -1, text, min(self.linked, len(text))))
            self.buffer, self.linked = [], 0

    def pop(self) -> None:
        tag, noise, container = self.open.pop()
        if tag in BLOCKS:
            self.flush()
        self.count[tag] -= 1
        self.noise -= noise
        self.links -= tag == "a"
        self.articles -= tag in ("article", "main")
        if container:
            self.around.pop()
            self.between.pop()
        elif shown_step(tag):
            self.between[-1].pop()

    def close_to(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self.pop()
                return
            if self.open[k][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self.close_to(("p",), CONTAINERS - {"div"} | {"blockquote", "li", "table", "button"})
        if tag == "li":
            self.close_to(("li",), frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            self.close_to(("dt", "dd"), frozenset(("dl",)))
        elif tag in ("td", "th"):
            self.close_to(("td", "th"), frozenset(("tr", "table")))
        elif tag == "tr":
            self.close_to(("tr",), frozenset(("table",)))
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            if not self.noise:
                self.buffer.append(" " if tag in ("br", "wbr", "img") else "")
            return
        given = dict(attrs)
        noise = is_noise(tag, given, self.articles > 0)
        container = tag in CONTAINERS and not noise and not self.noise
        if container:
            self.steps.append([*self.between[-1], general(tag, given)])
            self.parents.append(self.around[-1] if self.around else -1)
            self.around.append(len(self.parents) - 1)
            self.between.append([])
        elif shown_step(tag):
            self.between[-1].append(general(tag, given))
        self.open.append((tag, noise, container))
        self.count[tag] += 1
        self.noise += noise
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "path", "iframe", "script"):
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "br") and not self.count[tag]:
            if not self.noise:
                self.flush()
            return
        if tag in BLOCKS and not self.noise:
            self.flush()
        stop = frozenset() if tag in BLOCKS or tag in DROPPED else BLOCKS
        self.close_to((tag,), stop)

    def handle_data(self, data: str) -> None:
        if not self.noise:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data.strip())


def shown_step(tag: str) -> bool:
    """Whether a tag is a step of the paths below it."""
    return tag in BLOCKS and not re.fullmatch(r"p|h[1-6]|li", tag)


def parse(html: str | None) -> Blocks:
    """A page's blocks and containers; a tag that the page's end cuts off is left out."""
    html = html or ""
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match(r"<(?:[a-zA-Z/!?]|$)", html[cut:]):
        html = html[:cut]
    page = Blocks()
    page.feed(html)
    page.close()
    while page.open:
        page.pop()
    page.flush()
    return page


def keys_of(page: Blocks) -> list[bytes]:
    """A digest of each container's path, from its parent's and its own steps."""
    keys: list[bytes] = []
    for parent, steps in zip(page.parents, page.steps, strict=True):
        keys.append(hashlib.blake2b("/".join(steps).encode("utf-8", "surrogatepass"), digest_size=16, key=keys[parent] if parent >= 0 else b"").digest())
    return keys


def path_of(page: Blocks, container: int) -> str:
    parts = []
    while container >= 0:
        parts.append("/".join(page.steps[container]))
        container = page.parents[container]
    return "/".join(reversed(parts))


def scores(page: Blocks, keys: list[bytes]) -> dict[bytes, float]:
    """Score of each container path: text outside links counts in full for the innermost container, and less the further out.

    Semantic containers weigh more; text in links counts against.  Sums go up
    the tree once.
    """
    below = [0.0] * len(keys)
    for c, text, linked in page.blocks:
        if c >= 0:
            below[c] += len(text) - 2.0 * linked
    out: dict[bytes, float] = {}
    for c in range(len(keys) - 1, -1, -1):
        weight = {"article": 1.5, "main": 1.2, "body": 0.5}.get(page.steps[c][-1].split(".")[0], 1.0)
        out[keys[c]] = out.get(keys[c], 0.0) + below[c] * weight
        if page.parents[c] >= 0:
            below[page.parents[c]] += 0.8 * below[c]
    return out


def best_path(page: Blocks, keys: list[bytes]) -> tuple[bytes, str, float] | None:
    """(digest, path, score) of the best path; of equals the first by code point."""
    own = scores(page, keys)
    if not own or not page.blocks:
        return None
    top = max(own.values())
    first = {k: c for c, k in reversed(list(enumerate(keys))) if own[k] == top}
    path, key = min((path_of(page, c), k) for k, c in first.items())
    return key, path, top


def text_under(page: Blocks, key: bytes | None) -> str:
    """Text of the blocks inside containers of the path with this digest, or of the page's own best path if it has none such."""
    keys = keys_of(page)
    if key is None or key not in keys:
        best = best_path(page, keys)
        key = best[0] if best else None
    if key is None:
        return "\n".join(t for _, t, _ in page.blocks)
    inside: list[bool] = []
    for k, parent in zip(keys, page.parents, strict=True):
        inside.append(k == key or parent >= 0 and inside[parent])
    return "\n".join(t for c, t, _ in page.blocks if c >= 0 and inside[c])


def host_of(url):
    """Lower-case host of a URL column without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per host and path: pages that rank the path first, and its summed score."""

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found = [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(html)
                if best := best_path(page, keys_of(page)):
                    hosts.append(host)
                    found.append(best)
            columns = [pa.array([f[k] for f in found], t) for k, t in ((0, pa.binary()), (1, pa.string()), (2, pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *columns], names=["host", "key", "path", "score"])

    cast = df.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(ballots, "host string, key binary, path string, score double")
    return cast.groupBy("host", "key").agg(F.min("path").alias("path"), F.count("*").alias("votes"), F.sum("score").alias("score"))


def winning_paths(counted: DataFrame) -> DataFrame:
    """One path and its digest per host: most votes, then the last path by code point."""
    return counted.groupBy("host").agg(F.max(F.struct("votes", "path", "key")).alias("w")).select("host", "w.path", "w.key")


def extract_main_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", host_bound: int = HOST_BOUND
) -> DataFrame:
    """row_id, url, path, text per page.

    Both passes parse pages where they are; what is shuffled is one row per
    host, path and task.  Winners reach the pages by a broadcast of checked
    size, beyond ``host_bound`` hosts by a join that adaptive execution splits
    where a host is hot.  A page without the winning path uses its own best.

    White space of a block becomes one space, blocks are joined by a line
    feed.  A null page and one without text give an empty text; pages without
    a host vote together.  Repeated rows give repeated results.
    """
    work = Scratch(df.sparkSession, "html-consensus")
    winners = work.save(winning_paths(votes(df, url_col, html_col)), "winners")
    pages = df.select(
        F.col(id_col).alias("row_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    joined = pages.join(bounded(winners, host_bound), "host", "left").select("row_id", "url", "path", "html", "key")
    id_type = joined.schema["row_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_under(parse(html), key) for html, key in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["row_id", "url", "path", "text"])

    return joined.mapInArrow(extract, f"row_id {id_type}, url string, path string, text string")
