"""Personal data by a skip-chain conditional random field.

Patterns give the base entities.  A random field over each document's tokens
extends them: neighbouring tokens share chain potentials, repeated or similar
tokens at any distance share skip potentials, and loopy belief propagation
makes their labels agree.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in their listed order.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents and tokens that the field is fitted on, in expectation and at most; a hash of the id picks them.
SAMPLE_DOCS, SAMPLE_TOKENS = 20_000, 60_000
DIMS = 1 << 13
ROUNDS, DAMP, SURE = 12, 0.3, 0.9
#: Most digits of the kinds that go by digits.
MOST_DIGITS = {"card": 19, "phone": 15}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MAY = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = "\"'`.,;:!?()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind, then start; each kind leftmost and non-overlapping.

    Runs are entered at their start only, so long runs cost no more than their length.
    """
    if not _MAY.search(text):
        return []
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def shape(word: str) -> str:
    """Letters as a, digits as 9, runs of three or more cut to two and a plus."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", word[:64]))
    return re.sub(r"(.)\1{2,}", r"\1\1+", s)


@dataclass
class Graph:
    """Tokens of a document that may be personal data: spans, words, features, chain and skip edges."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph_of(text: str) -> Graph:
    """Nodes are words with a digit or an @.  A chain edge joins neighbours; a skip edge joins each
    occurrence of a word, or of its seven or more digits, to the one before it, so edges grow with the nodes."""
    spans, features, chain, skip = [], [], [], []
    seen: dict[str, int] = {}
    before = None
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    for k, (a, b) in enumerate(words):
        word = text[a:b]
        if not _MAY.search(word):
            continue
        lead = len(word) - len(word.lstrip(_EDGE.replace("(", "")))
        tail = len(word) - len(word.rstrip(_EDGE.replace(")", "")))
        core = word[lead : len(word) - tail] if lead + tail < len(word) else word
        digits = _NOT_DIGIT.sub("", core)
        left = shape(text[slice(*words[k - 1])]) if k else "^"
        right = shape(text[slice(*words[k + 1])]) if k + 1 < len(words) else "$"
        n = len(digits)
        names = [
            "bias", f"s={shape(core)}", f"n={min(n, 20)}", f"@={'@' in core}", f"dots={min(core.count('.'), 4)}", f"plus={core[0] == '+'}",
            f"luhn={13 <= n <= 19 and luhn(digits)}", f"num={core.isdigit()}", f"l={left if _MAY.search(text[slice(*words[k - 1])]) or not k else 'w'}",
            f"r={right if k + 1 < len(words) and _MAY.search(text[slice(*words[k + 1])]) else 'w'}", f"s+n={shape(core)}/{n}",
        ]
        node = len(spans)
        spans.append((a + lead, a + lead + len(core)))
        features.append([zlib.crc32(x.encode()) % DIMS for x in names])
        if before is not None and before[0] == k - 1:
            chain.append((before[1], node))
        before = (k, node)
        for key in {core.casefold(), digits if n >= 7 else ""} - {""}:
            if key in seen and seen[key] != node:
                skip.append((seen[key], node))
            seen[key] = node
    return Graph(spans, features, chain, sorted(set(skip)))


def labels_of(graph: Graph, base: list[tuple[str, int, int]]) -> list[int]:
    """Label of each node: the kind of a base span that overlaps it, else 0."""
    out = [0] * len(graph.spans)
    ends = [d for _, d in graph.spans]
    for kind, a, b in base:
        for k in range(bisect.bisect_right(ends, a), len(ends)):
            if graph.spans[k][0] >= b:
                break
            if not out[k]:
                out[k] = 1 + KINDS.index(kind)
    return out


@dataclass
class Field:
    """Weights of the random field: per feature and label, per chain edge and per skip edge."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of each node by damped loopy belief propagation."""
        score = np.stack([self.unary[f].sum(0) for f in graph.features])
        edges = graph.chain + graph.skip
        if edges:
            pair = np.stack([self.chain] * len(graph.chain) + [self.skip] * len(graph.skip))
            a, b = np.array(edges).T
            source, target = np.concatenate((a, b)), np.concatenate((b, a))
            table = np.concatenate((pair, pair.transpose(0, 2, 1)))
            back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
            message = np.zeros((len(source), len(LABELS)))
            for _ in range(ROUNDS):
                total = score.copy()
                np.add.at(total, target, message)
                belief = total[source] - message[back]
                fresh = _log_sum(belief[:, :, None] + table, 1)
                fresh -= _log_sum(fresh, 1)[:, None]
                change = np.abs(fresh - message).max()
                message = DAMP * message + (1 - DAMP) * fresh
                if change < 1e-4:
                    break
            np.add.at(score, target, message)
        return np.exp(score - _log_sum(score, 1)[:, None])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def fit_field(rows: list[tuple[list[int], int]], chain: np.ndarray, skip: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Unary weights by softmax regression on weakly labelled tokens, pair weights from label agreement.

    ``chain`` and ``skip`` count pairs of labels.  A pair weight is the log of
    how much likelier the two labels are together than apart, within bounds.
    """
    unary = np.zeros((DIMS, len(LABELS)))
    if rows:
        index, target = np.array([f for f, _ in rows]), np.array([y for _, y in rows])
        wanted = np.eye(len(LABELS))[target]
        weight = (len(rows) / (len(LABELS) * np.maximum(wanted.sum(0), 1))) ** 0.5
        scale, squares = weight[target][:, None] / len(rows), np.full_like(unary, 1e-8)
        for _ in range(steps):
            score = unary[index].sum(1)
            error = (np.exp(score - _log_sum(score, 1)[:, None]) - wanted) * scale
            gradient = decay * unary
            np.add.at(gradient, index.ravel(), np.repeat(error, index.shape[1], 0))
            squares += gradient**2
            unary -= rate * gradient / np.sqrt(squares)

    def lift(counts: np.ndarray, most: float) -> np.ndarray:
        joint = counts + counts.T + 0.5
        joint = joint / joint.sum()
        single = joint.sum(0)
        return np.clip(np.log(joint / np.outer(single, single)), -most, most)

    return Field(unary, lift(chain, 1.5), np.where(np.eye(len(LABELS)) > 0, np.maximum(lift(skip, 2.5), 0.5), np.minimum(lift(skip, 2.5), -0.5)))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Field:
    """Fit a field on a bounded sample: about ``sample_docs`` documents, at most ``sample_tokens`` of their tokens.

    Base entities are the weak labels.  The sample's tokens and counts of label
    pairs are what reaches the driver: the first by a hash of id and text and
    the place in the text, so the field doesn't depend on how rows are dealt.
    """
    total = df.count()
    share = int(min(1.0, sample_docs / max(total, 1)) * (1 << 30))
    rows = df.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("field")), F.lit(1 << 30)) < share).select(F.col(text_col).alias("body"), F.xxhash64(id_col, text_col).alias("key"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, labels, kinds, keys, places = [], [], [], [], []
            for body, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body and _MAY.search(body):
                    graph = graph_of(body)
                    y = labels_of(graph, base_spans(body))
                    features += [*graph.features, *[[p, q] for p, q in ((y[a], y[b]) for a, b in graph.chain)], *[[y[a], y[b]] for a, b in graph.skip]]
                    labels += [*y, *[-1] * (len(graph.chain) + len(graph.skip))]
                    kinds += [*["token"] * len(y), *["chain"] * len(graph.chain), *["skip"] * len(graph.skip)]
                    places += range(len(kinds) - len(keys))
                    keys += [key] * (len(kinds) - len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(features, pa.list_(pa.int32())), pa.array(labels, pa.int32()), pa.array(kinds, pa.string()), pa.array(keys, pa.int64()), pa.array(places, pa.int32())],
                names=["features", "label", "kind", "key", "place"],
            )

    found = rows.mapInArrow(tokens, "features array<int>, label int, kind string, key long, place int")
    found = found.orderBy("key", "place").limit(3 * sample_tokens).collect()
    pairs = {k: np.zeros((len(LABELS), len(LABELS))) for k in ("chain", "skip")}
    for r in found:
        if r["kind"] != "token":
            pairs[r["kind"]][tuple(r["features"])] += 1
    return fit_field([(r["features"], r["label"]) for r in found if r["kind"] == "token"][:sample_tokens], pairs["chain"], pairs["skip"])


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Spans that the field adds: tokens with a sure label that overlap no base span; neighbours of one label are one span as far as that is plausible.

    A document without any sure evidence (no base span and no token whose own
    features make it an entity) gets nothing from its neighbours either.
    """
    if not _MAY.search(text):
        return []
    graph = graph_of(text)
    if not graph.spans:
        return []
    p = field.marginals(graph)
    best = p.argmax(1)
    labels = labels_of(graph, base)
    sure = [0 if labels[k] or p[k, best[k]] < SURE else int(best[k]) for k in range(len(graph.spans))]
    tied = tied_phones(text, graph, labels, sure)
    linked = set(graph.chain)
    out: list[tuple[str, int, int]] = []
    k = 0
    while k < len(sure):
        end = k + 1
        while sure[k] and end < len(sure) and sure[end] == sure[k] and (end - 1, end) in linked:
            end += 1
        if sure[k]:
            out += spans_of_run(text, KINDS[sure[k] - 1], graph.spans[k:end], [n in tied for n in range(k, end)])
        k = end
    return out


def tied_phones(text: str, graph: Graph, labels: list[int], sure: list[int]) -> set[int]:
    """Sure phone nodes that skip edges join, by way of others, to a phone that isn't a mere run of digits: one of a base span or one with signs of its own."""
    phone = 1 + KINDS.index("phone")
    near: dict[int, list[int]] = {}
    for a, b in graph.skip:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    todo = [k for k in near if labels[k] == phone or (sure[k] == phone and plausible("phone", text[slice(*graph.spans[k])]))]
    tied = set(todo)
    while todo:
        for k in near[todo.pop()]:
            if k not in tied and sure[k] == phone:
                tied.add(k)
                todo.append(k)
    return tied


def spans_of_run(text: str, kind: str, nodes: list[tuple[int, int]], tied: list[bool]) -> list[tuple[str, int, int]]:
    """The plausible spans that cover most nodes of a run of neighbours with one label; of equal covers the one with most spans."""
    join = lambda i, j: (kind, nodes[i][0], nodes[j][1])
    fits = lambda i, j: plausible(kind, text[nodes[i][0] : nodes[j][1]], i == j and tied[i])
    if kind == "ip":
        return [join(i, i) for i in range(len(nodes)) if fits(i, i)]
    if kind == "email":
        out, first = [], 0
        for k in range(1, len(nodes)):
            if fits(k, k) and fits(first, k - 1):
                out.append(join(first, k - 1))
                first = k
        return out + ([join(first, len(nodes) - 1)] if fits(first, len(nodes) - 1) else [])
    size = [max(1, len(_NOT_DIGIT.sub("", text[a:b]))) for a, b in nodes]
    best: list[tuple[int, int]] = [(0, 0)]
    back = [-1]
    for j in range(len(nodes)):
        most, start, total, i = best[j], -1, 0, j
        while i >= 0 and (total := total + size[i]) <= MOST_DIGITS[kind]:
            if fits(i, j) and (found := (best[i][0] + j + 1 - i, best[i][1] + 1)) > most:
                most, start = found, i
            i -= 1
        best.append(most)
        back.append(start)
    out, j = [], len(nodes)
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append(join(back[j], j - 1))
            j = back[j]
    return out[::-1]


def plausible(kind: str, found: str, tied: bool = False) -> bool:
    """Whether an added span has what its kind needs at least; digits alone are a phone only where they are ``tied`` to one."""
    n = len(_NOT_DIGIT.sub("", found))
    if kind == "email":
        return "@" in found[1:-1]
    if kind == "ip":
        parts = found.split(".")
        return len(parts) == 4 and all(x.isdigit() and len(x) < 4 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 13 <= n <= MOST_DIGITS[kind] and luhn(_NOT_DIGIT.sub("", found))
    return 9 <= n <= MOST_DIGITS[kind] and (tied or not found.isdigit())


def find_personal_data(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, base and spans per row, each an array of (kind, start, end).

    Base spans always stay; ``spans`` adds what the field finds.  One pass over
    the texts, no shuffle.  A null text is empty; an empty table gives an empty
    result.
    """
    field = field or train(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast((field.unary, field.chain, field.skip))
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        as_row = lambda s: {"kind": s[0], "start": s[1], "end": s[2]}
        for batch in batches:
            base, every = [], []
            for body in batch.column(1).to_pylist():
                found = base_spans(body or "")
                more = added_spans(body or "", found, own)
                base.append([as_row(s) for s in found])
                every.append([as_row(s) for s in sorted(found + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], names=["row_id", "base", "spans"])

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(scan, f"row_id {id_type}, base {spans}, spans {spans}")
