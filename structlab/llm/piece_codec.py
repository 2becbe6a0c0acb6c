"""Encoding into and decoding from the pieces of a SentencePiece BPE model, with the bytes of the original text that each piece stands for.

Normalisation replaces the longest prefix that the model's compiled character
map knows, and notes for each normalised byte where it came from.  Between two
characters that no piece holds side by side no merge can happen, so the
normalised text falls into units; each distinct unit is merged once while a
table holds it.  Pieces are projected through the notes to byte spans.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlab.llm import textnum
from structlab.llm.unit_encoder import UNIT_BYTES, UnitTable, distinct, spans

#: The sign that stands for a space in pieces; inside this module a space is one byte, 0x20.
SPACE_SIGN = "▁"
#: Bytes of text that are encoded at a time (a longer text is one piece).
ENCODED_BYTES = 1 << 21
#: Ids that are decoded at a time (a longer row is one piece).
DECODED_IDS = 1 << 19
#: Units that are looked up as bytes, and the longest such that is remembered.
LONG_UNITS, LONG_UNIT_BYTES = 50_000, 256
#: Fixed values of the model format: kinds of pieces, and the kind of model that merges by score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message; nested ones and strings stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """Longest-prefix replacements of a compiled character map: a double-array trie over keys, then the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.texts = blob[4 + size :]
        self.first = np.zeros((256, 256), bool)  # whether a key starts with these bytes, or is the first of them
        for a in range(256) if self.units else ():
            node = self.child(self.root(), a)
            if node is not None:
                self.first[a] = True if self.ends(node) else [self.child(node, b) is not None for b in range(256)]

    def offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def root(self) -> int:
        return self.offset(self.units[0])

    def child(self, node: int, byte: int) -> int | None:
        """Where the children of the node after ``byte`` start, with the node's own place in the array."""
        place = (node & 0xFFFFFFFF) ^ byte
        unit = self.units[place] if place < len(self.units) else 0
        return (place << 32) | (place ^ self.offset(unit)) if unit & 0x800000FF == byte else None

    def ends(self, node: int) -> bool:
        return bool(self.units[node >> 32] >> 8 & 1)

    def longest(self, raw: bytes, at: int, end: int) -> tuple[int, bytes] | None:
        """(length of the longest key at ``at``, its replacement)."""
        node, found = self.root(), None
        for k in range(at, end):
            node = self.child(node, raw[k])
            if node is None:
                break
            if self.ends(node):
                found = k + 1 - at, self.units[node & 0xFFFFFFFF] & 0x7FFFFFFF
        return found and (found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])])


class PieceModel:
    """Pieces, merges and normalisation of a model file; BPE without user-defined or unused pieces."""

    def __init__(self, raw: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(raw):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
            elif number == 5 and dict(fields(value)).get(2):
                raise ValueError("a map for decoding isn't supported")
        self.text = [p[1].decode() for p in pieces]
        self.kind = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != BPE or not normalizer.get(5, 1) or trainer.get(24, 0) or {USER_DEFINED, UNUSED} & set(self.kind):
            raise ValueError("only BPE models with escaped leading spaces, without user-defined or unused pieces")
        self.dummy, self.trim = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.fallback, self.unknown = bool(trainer.get(35, 0)), self.kind.index(UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.map = CharacterMap(normalizer.get(2, b""))
        self.rank = {t: (-struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], i) for i, (t, p, k) in enumerate(zip(self.text, pieces, self.kind, strict=True)) if k == NORMAL}
        self.byte_id = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.joins = np.zeros((256, 256), bool)  # last byte of a character, first of the next, that some piece holds
        for t in self.rank:
            each = [c.encode() for c in t.replace(SPACE_SIGN, " ")]
            for a, b in zip(each, each[1:], strict=False):
                self.joins[a[-1], b[0]] = True
        if max(map(len, map(str.encode, self.rank)), default=0) > 255 or len(self.text) >= 1 << 24:
            raise ValueError("pieces are too long or too many")
        self.table, self.long = UnitTable(), {}
        surfaces = [self.surface(i) for i in range(len(pieces))]
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_at = np.cumsum([0, *map(len, surfaces)])
        self.plain = np.array([k in (NORMAL, BYTE) for k in self.kind])
        self.is_byte = np.array([k == BYTE for k in self.kind])
        self.leads = np.array([k == NORMAL and t.startswith(SPACE_SIGN) for t, k in zip(self.text, self.kind, strict=True)])

    def surface(self, i: int) -> bytes:
        if self.kind[i] == CONTROL:
            return b""
        if self.kind[i] == BYTE:
            return bytes([int(self.text[i][3:5], 16)])
        return self.unknown_text if self.kind[i] == UNKNOWN else self.text[i].replace(SPACE_SIGN, " ").encode()

    # Normalisation

    def replaced(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, origin of each byte, offsets, places of what goes without a trace) after the character map.

        A byte's origin is where the prefix begins that it replaces.
        """
        lead = (raw & 0xC0) != 0x80
        origin = np.maximum.accumulate(np.where(lead, np.arange(len(raw)), 0)) if len(raw) else np.zeros(0, np.int64)
        if not self.map.units:
            return raw, origin, offsets, np.zeros(0, np.int64)
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        after = np.append(raw[1:], np.uint8(0))
        places = np.flatnonzero(lead & self.map.first[raw, after])
        whole, stop = raw.tobytes(), offsets[np.searchsorted(offsets, places, "right")]
        kept, parts, sources, out_at, done = np.ones(len(raw), bool), [], [], [], 0
        for at, end in zip(places.tolist(), stop.tolist(), strict=True):
            if at >= done and (found := self.map.longest(whole, at, end)):
                done = at + found[0]
                kept[at:done] = False
                parts.append(found[1])
                out_at.append(at)
        size = np.array([len(p) for p in parts], np.int64)
        new = np.frombuffer(b"".join(parts), np.uint8)
        sources = np.repeat(np.array(out_at, np.int64), size)
        order = np.argsort(np.concatenate((origin[kept], sources)), kind="stable")
        origin_all = np.concatenate((origin[kept], sources))[order]
        return np.concatenate((raw[kept], new))[order], origin_all, np.searchsorted(origin_all, offsets), np.array(out_at, np.int64)[size == 0]

    def normalise(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, origin, offsets) of normalised rows; ``origin`` has one entry more per row, the end of what its last byte stands for.

        Entries of a row begin at its offset plus its number.
        """
        data, origin, at, gone = self.replaced(raw, offsets)
        rows, ends = len(offsets) - 1, offsets[1:].copy()
        row = np.repeat(np.arange(rows), np.diff(at))
        if self.trim and len(data):
            space = data == 0x20
            new = np.ones(len(data), bool)  # begins a prefix of the original
            new[1:] = origin[1:] != origin[:-1]
            begin = np.flatnonzero(new)
            chunk = np.cumsum(new) - 1
            solid = np.cumsum(~space)
            leading = space & (solid == (solid - ~space)[begin][chunk])
            before = np.zeros(len(data) + 1, bool)
            before[1:] = space
            before[at[:-1]] = True
            kept = ~(leading & before[begin][chunk])
            data, origin, row = data[kept], origin[kept], row[kept]
        sign = np.frombuffer(SPACE_SIGN.encode(), np.uint8)
        if len(data) > 2:
            signs = np.flatnonzero((data[:-2] == sign[0]) & (data[1:-1] == sign[1]) & (data[2:] == sign[2]))
            if len(signs):
                data = data.copy()
                data[signs] = 0x20
                kept = np.ones(len(data), bool)
                kept[signs + 1] = kept[signs + 2] = False
                data, origin, row = data[kept], origin[kept], row[kept]
        if self.trim and len(data):
            solid_at = np.flatnonzero(data != 0x20)
            last = np.full(rows, -1)
            last[row[solid_at]] = solid_at
            tail = np.arange(len(data)) > last[row]
            ends[row[tail][::-1]] = origin[tail][::-1]
            data, origin, row = data[~tail], origin[~tail], row[~tail]
        count = np.bincount(row, minlength=rows)
        at = np.concatenate(([0], np.cumsum(count)))
        if self.dummy:
            some = count > 0 if self.trim else np.diff(offsets) > 0
            full = np.flatnonzero(some)
            begin = offsets[full]
            if self.trim:  # after leading spaces, up to the first character that counts or goes
                begin = np.minimum(origin[at[full]], np.append(gone, len(raw))[np.searchsorted(gone, begin)])
            data, origin = np.insert(data, at[full], np.uint8(0x20)), np.insert(origin, at[full], begin)
            at = at + np.concatenate(([0], np.cumsum(some)))
        return data, np.insert(origin, at[1:], ends), at

    # Merging

    def merged(self, unit: bytes) -> tuple[list[int], list[int]]:
        """(ids, bytes of each) of a unit: the pair with the best score merges first, the leftmost of equals."""
        parts = [c if c != " " else SPACE_SIGN for c in unit.decode()]
        right, left, rank = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), self.rank
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (found := rank.get(parts[a] + parts[b])):
                heapq.heappush(heap, (found[0], a, b, len(parts[a]) + len(parts[b])))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            right[a] = right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        ids, sizes = [], []
        for p in filter(None, parts):
            own = p.replace(SPACE_SIGN, " ").encode()
            if p in rank:
                ids.append(rank[p][1])
                sizes.append(len(own))
            elif self.fallback:
                raw = p.encode()
                ids += [self.byte_id[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(own)]
            else:
                ids.append(self.unknown)
                sizes.append(len(own))
        return ids, sizes

    def packed(self, unit: bytes) -> np.ndarray:
        """Ids of a unit with the bytes of each in the upper eight bits."""
        if unit in self.long:
            return self.long[unit]
        ids, sizes = self.merged(unit)
        out = np.array(ids, np.uint32) | np.array(sizes, np.uint32) << np.uint32(24)
        if len(unit) <= LONG_UNIT_BYTES:
            if len(self.long) >= LONG_UNITS:
                self.long.clear()
            self.long[unit] = out
        return out

    def known(self, low: np.ndarray, high: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, packed ids) of short units, given as numbers."""
        table, size = self.table, end - start
        unit = table.find(low, high)
        missing = np.flatnonzero(unit < 0)
        if len(missing):
            one = missing[distinct(low[missing], high[missing])]
            if not self.room(table, size[one]):
                table.clear()
                missing = np.arange(len(unit))
                one = distinct(low, high)
                if not self.room(table, size[one]):
                    half = len(low) // 2
                    a, b = (self.known(low[s], high[s], data, start[s], end[s]) for s in (slice(0, half), slice(half, None)))
                    return np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
            found = [self.merged(data[a:b].tobytes()) for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            ids = np.array([i for x, _ in found for i in x], np.uint32) | np.array([n for _, x in found for n in x], np.uint32) << np.uint32(24)
            table.add(low[one], high[one], np.array([len(x) for x, _ in found]), ids)
            unit[missing] = table.find(low[missing], high[missing])
        begin = table.start[unit]
        count = table.start[unit + 1] - begin
        return count, table.ids[np.repeat(begin, count) + spans(count)]

    @staticmethod
    def room(table: UnitTable, size: np.ndarray) -> bool:
        return table.n + len(size) <= table.key.shape[1] and table.start[table.n] + 4 * size.sum() <= len(table.ids)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end, offsets of ids): ids of rows of UTF-8 bytes, and which of a row's bytes each stands for."""
        data, origin, at = self.normalise(raw, offsets)
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        cut[1:-1] |= ((data[1:] & 0xC0) != 0x80) & ~self.joins[data[:-1], data[1:]]
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(data))
        size = end - start
        short = size <= UNIT_BYTES
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        s, n = start[short], size[short]
        low = eight[s] & _MASK[np.minimum(n, 8)]
        high = eight[s + 8 * (n > 8)] * (n > 8) & _MASK[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        count, packed = self.known(low, high, data, s, end[short])
        total = np.zeros(len(start), np.int64)
        total[short] = count
        if not short.all():
            others = [self.packed(data[a:b].tobytes()) for a, b in zip(start[~short].tolist(), end[~short].tolist(), strict=True)]
            total[~short] = [len(x) for x in others]
            out, of_short = np.zeros(int(total.sum()), np.uint32), np.repeat(short, total)
            out[of_short], out[~of_short] = packed, np.concatenate(others)
            packed = out
        ids, length = (packed & np.uint32(0xFFFFFF)).astype(np.int64), (packed >> np.uint32(24)).astype(np.int64)
        row = np.repeat(np.searchsorted(at, start, "right") - 1, total)
        stop = np.cumsum(length)
        if not self.fallback and len(ids) > 1:  # neighbouring unknown characters are one piece
            kept = np.ones(len(ids), bool)
            kept[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown) | (row[1:] != row[:-1])
            length = np.add.reduceat(length, np.flatnonzero(kept))
            ids, row = ids[kept], row[kept]
            stop = np.cumsum(length)
        begin, finish = origin[stop - length + row], origin[stop + row]
        finish = np.where(length == 0, begin, finish)
        first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))))
        return ids, begin - offsets[row], finish - offsets[row], first

    # Decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offsets) of rows of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.text)):
            raise IndexError("an id that the model doesn't have")
        size = np.diff(self.surface_at)[ids]
        first = offsets[:-1][np.diff(offsets) > 0]
        skip = np.zeros(len(ids), np.int64)
        if self.dummy or self.trim:
            skip[first] = self.leads[ids[first]]
        size = size - skip
        data = self.surfaces[np.repeat(self.surface_at[ids] + skip, size) + spans(size)]
        at = np.concatenate(([0], np.cumsum(size)))[offsets]
        odd = np.zeros(len(offsets) - 1, bool)  # rows that the arrays don't settle
        full = np.flatnonzero(np.diff(offsets) > 0)
        odd[full] = ~self.plain[ids[first]] | (self.trim & (size[first] == 0))
        try:
            data.tobytes().decode()
            inner = at[(at > 0) & (at < len(data))]
            odd |= bool(len(inner)) and bool(((data[inner] & 0xC0) == 0x80).any())
        except UnicodeDecodeError:
            odd |= True
        if not odd.any():
            return data, at
        parts = [self.one(ids[a:b].tolist()) if o else data[x:y].tobytes() for o, a, b, x, y in zip(odd.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])

    def one(self, ids: list[int]) -> bytes:
        """The text of one row, piece by piece; a byte that isn't part of a character becomes U+FFFD."""
        out, run, seen = [], bytearray(), False

        def close() -> None:
            at = 0
            while at < len(run):
                for n in (4, 3, 2, 1):
                    try:
                        if len(run[at : at + n].decode()) == 1 and len(run[at : at + n]) == n:
                            out.append(bytes(run[at : at + n]))
                            break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("�".encode())
                at += n
            run.clear()

        for i in ids:
            if self.kind[i] == BYTE:
                run += self.surface(i)
                continue
            close()
            surface, bare = self.surface(i), self.kind[i] in (CONTROL, UNKNOWN)
            if not bare and not seen and not any(out) and (self.dummy or self.trim) and self.leads[i]:
                surface, seen = surface[1:], not self.trim
            out.append(surface)
        close()
        return b"".join(out)


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of this worker process; its table of units outlives a task."""
    if path not in _MODELS:
        _MODELS.clear()
        with open(path, "rb") as f:
            _MODELS[path] = PieceModel(f.read())
    return _MODELS[path]


def encode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, ids, begins, ends of each row: the pieces of its text, and the bytes of the text from begin to end that each stands for.

    A null or empty text has no pieces.  Of a character that falls back to
    several byte pieces the last one has the span.  Nothing is shuffled;
    repeated rows stay as many.  ``model_path`` must be readable on every node.
    """
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            raw, offsets = textnum.utf8(batch.column(1))
            for low, high in textnum.pieces(raw, offsets, ENCODED_BYTES):
                ids, begin, end, at = model.encode(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                at = pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (ids, begin, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *lists], names=["row_id", "ids", "begins", "ends"])

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(encode, f"row_id {id_type}, ids array<int>, begins array<int>, ends array<int>")


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with its column of ids replaced by the text that they decode to; null or no ids give an empty text.

    An id that the model doesn't have raises IndexError.
    """
    names = [c for c in df.columns if c != ids_col]
    kept = df.select(*names).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            column = batch.column(len(names))
            ids = column.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy())))
            for low, high in textnum.pieces(ids, first, DECODED_IDS):
                data, at = model.decode(ids[first[low] : first[high]], first[low : high + 1] - first[low])
                text = pa.Array.from_buffers(pa.large_string(), high - low, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in range(len(names))), text.cast(pa.string())], names=[*names, out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out_col}` string"])
    return df.select(*names, ids_col).mapInArrow(decode, schema)
