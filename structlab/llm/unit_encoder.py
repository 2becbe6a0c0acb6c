"""Token ids of whole texts, a batch at a time: units of text are looked up as numbers, and only new ones are tokenized."""

from __future__ import annotations

import os
import re

import numpy as np

from structlab.llm.textnum import mix

#: Slots of a worker's table of units, the units it holds before it starts anew, and the most ids of theirs; about 40 MB.
SLOTS, UNITS, UNIT_IDS = 1 << 20, 650_000, 4_000_000
#: Chunks that are looked up as text, and the longest such that is remembered.
CHUNKS, CHUNK_LENGTH = 20_000, 64
#: Most bytes of a unit that is looked up as a number: fifteen and its length fill 128 bits.
UNIT_BYTES = 15
#: ASCII without controls, and the accented letters of Latin-1, whose lower case and composed form are one character each.
_PLAIN = re.compile("[\\x21-\\x7EÀ-ÖØ-öø-ÿ]+")
#: Fixed value: what the tokenizer splits such text into.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ÿ]+")

_GAP, _SIGN, _DIGIT, _LETTER = range(4)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[0x20, 0x0A]] = _GAP
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER
#: Bytes that plain text doesn't have (and the apostrophe, which may bind the letters after it).
_ODD = np.zeros(256, bool)
_ODD[[*range(0x0A), *range(0x0B, 0x20), 0x7F, 0x27, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, ..., counts[0] - 1, 0, 1, ..., counts[1] - 1 and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def distinct(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One place of each pair of values."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
    return order[new]


class UnitTable:
    """Ids of units by their bytes: open addressing over arrays, of bounded size."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(SLOTS, -1, np.int32)
        self.key = np.zeros((2, UNITS), np.uint64)
        self.start = np.zeros(UNITS + 1, np.int64)
        self.ids = np.zeros(UNIT_IDS, np.uint32)
        self.n = 0

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each unit; -1 for new ones."""
        out = np.full(len(low), -1, np.int64)
        at = (mix(low ^ mix(high)) & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(low))
        while len(left):
            unit = self.slot[at]
            used = unit >= 0
            left, at, unit = left[used], at[used], unit[used]
            same = (self.key[0, unit] == low[left]) & (self.key[1, unit] == high[left])
            out[left[same]] = unit[same]
            left, at = left[~same], (at[~same] + 1) & (SLOTS - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new units, in order, with their ids one after the other."""
        new = np.arange(self.n, self.n + len(low))
        self.key[0, new], self.key[1, new] = low, high
        self.start[new + 1] = self.start[self.n] + np.cumsum(counts)
        self.ids[self.start[self.n] : self.start[self.n] + len(ids)] = ids
        self.n += len(low)
        at = (mix(low ^ mix(high)) & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(new):
            free = self.slot[at] < 0
            self.slot[at[free]] = new[free]
            lost = self.slot[at] != new
            new, at = new[lost], (at[lost] + 1) & (SLOTS - 1)


class TextEncoder:
    """Token ids of texts by a tokenizer whose tokens never span white space.

    So the ids of a text are those of its chunks between spaces and line ends,
    one after the other.  A chunk of plain Latin characters is in turn its
    lower-cased words, digits and runs of other signs: units, of which each
    distinct one is tokenized once while the table holds it.  Any other chunk,
    one that may hold a special token, one with an apostrophe and one with a
    unit of over ``UNIT_BYTES`` goes to the tokenizer as text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.units = UnitTable()
        self.chunks: dict[str, np.ndarray] = {}

    def texts(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of units of plain text: tokenized together, and told apart by the tokens that end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(units) and len(ids) == last[-1] + 1:
            return np.diff(last, prepend=-1), ids
        each = [c.ids for c in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([len(c) for c in each]), np.array([i for c in each for i in c], np.uint32)

    def chunk(self, text: str) -> np.ndarray:
        if text in self.chunks:
            return self.chunks[text]
        parts = _PARTS.findall(text.lower()) if _PLAIN.fullmatch(text) and "<|" not in text else [text]
        coded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        out = np.array([i for c in coded for i in c.ids], np.uint32)
        if len(text) <= CHUNK_LENGTH:
            if len(self.chunks) >= CHUNKS:
                self.chunks.clear()
            self.chunks[text] = out
        return out

    def learn(self, low: np.ndarray, high: np.ndarray, lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        counts, ids = self.texts([lower[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        self.units.add(low, high, counts, ids)

    def room(self, size: np.ndarray) -> bool:
        """Whether the table has room for units of these sizes."""
        return self.units.n + len(size) <= UNITS and self.units.start[self.units.n] + size.sum() <= UNIT_IDS

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of ids) of rows of UTF-8 bytes; pieces of a few megabytes keep the arrays small."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind, odd = _KIND[raw], _ODD[raw]
        lower = np.zeros(n + 16, np.uint8)
        lower[:n] = _LOWER[raw]
        wide = np.flatnonzero(raw[:-1] == 0xC3) + 1
        second = raw[wide]
        lower[wide[(second >= 0x80) & (second <= 0x9E)]] += 0x20
        odd[wide[(second == 0x97) | (second == 0xB7)]] = True
        odd[np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))] = True
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        gap = kind == _GAP
        cut = edge.copy()
        cut[1:n] |= gap[1:] != gap[:-1]
        first = np.flatnonzero(cut[:n] & ~gap)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.flatnonzero(cut)
        stop = bounds[np.searchsorted(bounds, first, "right")]
        cut[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        start = np.flatnonzero(cut[:n] & ~gap)
        bounds = np.flatnonzero(cut)
        end = bounds[np.searchsorted(bounds, start, "right")]
        chunk = np.searchsorted(first, start, "right") - 1
        strange = np.zeros(len(first), bool)
        strange[np.searchsorted(first, np.flatnonzero(odd), "right") - 1] = True
        strange[chunk[end - start > UNIT_BYTES]] = True
        plain = ~strange[chunk]
        start, end, chunk = start[plain], end[plain], chunk[plain]
        eight = np.ndarray((n + 9,), "<u8", lower, strides=(1,))
        size = end - start
        low = eight[start] & _MASK[np.minimum(size, 8)]
        high = eight[start + 8 * (size > 8)] * (size > 8) & _MASK[np.maximum(size - 8, 0)] | size.astype(np.uint64) << np.uint64(56)
        unit = self.units.find(low, high)
        missing = np.flatnonzero(unit < 0)
        if len(missing):
            one = missing[distinct(low[missing], high[missing])]
            if not self.room(size[one]):
                self.units.clear()
                missing = np.arange(len(unit))
                one = distinct(low, high)
                if not self.room(size[one]):
                    return self.halves(raw, offsets, first)
            self.learn(low[one], high[one], lower, start[one], end[one])
            unit[missing] = self.units.find(low[missing], high[missing])
        begin = self.units.start[unit]
        count = self.units.start[unit + 1] - begin
        ids = self.units.ids[np.repeat(begin, count) + spans(count)]
        place, odd_chunks = np.searchsorted(offsets, first, "right") - 1, np.flatnonzero(strange)
        total = np.bincount(chunk, count, minlength=len(first)).astype(np.int64)
        if len(odd_chunks):
            strange_ids = [self.chunk(raw[a:b].tobytes().decode()) for a, b in zip(first[odd_chunks].tolist(), stop[odd_chunks].tolist(), strict=True)]
            total[odd_chunks] = [len(x) for x in strange_ids]
            out = np.zeros(int(total.sum()), np.uint32)
            strange_at = np.repeat(strange, total)
            out[~strange_at], out[strange_at] = ids, np.concatenate(strange_ids)
            ids = out
        per_row = np.bincount(place, total, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_row)))

    def halves(self, raw: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of both halves of the bytes, cut where a chunk starts; a chunk that alone is too much is taken as text."""
        if len(first) == 1:
            ids = self.chunk(raw.tobytes().decode().strip(" \n"))
            return ids, np.where(offsets > first[0], len(ids), 0)
        at = int(first[np.searchsorted(first, len(raw) // 2).clip(1, len(first) - 1)])
        left, a = self.encode(raw[:at], np.minimum(offsets, at))
        right, b = self.encode(raw[at:], np.maximum(offsets - at, 0))
        return np.concatenate((left, right)), a + b


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this worker process: its table outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def text_ids(path: str, text: str) -> list[int]:
    """Ids of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return TextEncoder(path).encode(raw, np.array([0, len(raw)]))[0].tolist()
