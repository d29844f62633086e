"""Piece encoding and decoding with a max-plus parallel scan.

A text is split into vocabulary pieces so that the sum of their log weights is largest.  Best
sums are products of matrices in the (max, +) algebra: a chunk of text is a matrix from the
state at its start to the state at its end, where a state is the number of characters by
which the last cut lies before the boundary.  A giant text is cut into chunks anywhere; the chunks' matrices
are computed side by side, combined by a prefix scan, which gives the states at all
boundaries, and each chunk is then traced back alone.

No piece reaches across the start of a space mark that follows another character, so
there the state is always 0: between two such places a chunk's sum is that of its units, and
units (mostly words) are solved together, one vectorised step for each length.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.sources.scratch import written

MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_CUT = re.compile(f"(?<=[^{MARK}]){MARK}")
_LONG = 64
_LOADED: dict[str, "Pieces"] = {}


@dataclass
class Pieces:
    """The vocabulary of a model file: weights fall with a piece's place as 1 / (place + 3)."""

    path: str
    remembered: int = 100_000
    known: dict[str, bytes] = field(default_factory=dict)  # unit: its ids as 32-bit numbers

    def __post_init__(self):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        weights = -np.log(np.arange(len(plain)) + 3.0)
        self.names = {i: model.id_to_piece(i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.byte_weight = float(weights.min()) - 10.0
        # One byte of ASCII is a text by itself; other bytes are read together.
        self.shown = self.names | {i: chr(b) for b, i in enumerate(self.bytes[:128])}
        self.high = np.zeros(model.get_piece_size(), bool)
        self.high[self.bytes[128:]] = True
        self.weight_of = np.full(model.get_piece_size(), self.byte_weight)
        self.weight_of[plain] = weights
        self.table = {model.id_to_piece(i): (float(w), i) for i, w in zip(plain, weights, strict=True)}
        self.longest = max(map(len, self.table))
        if any(MARK in x.lstrip(MARK) for x in self.table):
            raise ValueError("a piece holds a space mark after another character")
        # Open addressing by hash, for whole arrays of substrings.
        keys = self._hashes(list(self.table))
        self.slots = np.zeros(1 << 18, np.uint64)
        self.entry = np.full(1 << 18, -1, np.int32)
        self.weight = np.append(weights, -np.inf)
        self.ids = np.array(plain, np.int64)
        for n, key in enumerate(keys):
            at = int(key >> np.uint64(46))
            while self.entry[at] >= 0:
                at = (at + 1) & 0x3FFFF
            self.slots[at], self.entry[at] = key, n

    @staticmethod
    def _sums(chars: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(common.mixed(chars.astype(np.uint64)) * common._powers(common._ODD, len(chars)), out=out[1:])
        return out

    @classmethod
    def _hashes(cls, texts: Sequence[str]) -> np.ndarray:
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(x) for x in texts])
        return common.substring_hashes(cls._sums(chars), ends - [len(x) for x in texts], ends)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of hashed substrings, -1 if there is no such piece."""
        at = (keys >> np.uint64(46)).astype(np.int64)
        out, open_ = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(open_):
            entry, same = self.entry[at[open_]], self.slots[at[open_]] == keys[open_]
            hit = (entry >= 0) & same
            out[open_[hit]] = entry[hit]
            open_ = open_[(entry >= 0) & ~same]
            at[open_] = (at[open_] + 1) & 0x3FFFF
        return out

    def cost(self, char: str) -> float:
        return self.byte_weight * len(char.encode("utf-8", "replace"))

    def spelled(self, piece: str) -> list[int]:
        """A piece's id, or the ids of its bytes."""
        found = self.table.get(piece)
        return [found[1]] if found else [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    # -- units ----------------------------------------------------------------------------------

    def solve(self, units: Sequence[str]) -> list[bytes]:
        """Ids of each unit with the largest sum, all units advancing together."""
        if not units:
            return []
        sizes = np.array([len(u) for u in units])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        chars = np.frombuffer("".join([units[i] for i in order]).encode("utf-32-le", "replace"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        sums = self._sums(chars)
        most, many = int(sizes[0]), len(units)
        best = np.full((most + 1, many), -np.inf)
        back, entry = np.zeros((most + 1, many), np.int8), np.full((most + 1, many), -1, np.int32)
        best[0] = 0
        widths = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        for end in range(1, most + 1):
            n = int(np.searchsorted(-sizes, -end, side="right"))
            for length in range(1, min(end, self.longest) + 1):
                low = starts[:n] + end - length
                found = self._find(common.substring_hashes(sums, low, low + length))
                gain = self.weight[found]
                if length == 1:
                    gain = np.where(found < 0, self.byte_weight * widths[low], gain)
                total = best[end - length, :n] + gain
                better = np.flatnonzero(total > best[end, :n])
                best[end, better], back[end, better], entry[end, better] = total[better], length, found[better]
        # Back from the ends, all units together; then in the order of units and places.
        owner, place, piece = [], [], []
        unit, end = np.arange(many), sizes.copy()
        while len(unit):
            low = end - back[end, unit]
            owner.append(unit), place.append(low), piece.append(entry[end, unit])
            on = low > 0
            unit, end = unit[on], low[on]
        owner, place, piece = np.concatenate(owner), np.concatenate(place), np.concatenate(piece)
        sort = np.lexsort((place, owner))
        owner, place, piece = owner[sort], place[sort], piece[sort]
        char = chars[starts[owner] + place]
        ids = np.where(piece >= 0, self.ids[piece], np.array(self.bytes)[np.minimum(char, 127)]).astype(np.int32)
        odd = set(owner[(piece < 0) & (char > 127)].tolist())  # characters of several bytes
        ends = np.cumsum(np.bincount(owner, minlength=many))
        data, out = ids.tobytes(), [b""] * many
        for k, (low, high) in enumerate(zip((ends - np.bincount(owner, minlength=many)).tolist(), ends.tolist(), strict=True)):
            if k in odd:
                text, cuts = units[order[k]], [*place[low:high].tolist(), int(sizes[k])]
                out[order[k]] = np.array([i for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in self.spelled(text[a:b])], np.int32).tobytes()
            else:
                out[order[k]] = data[4 * low : 4 * high]
        return out

    def learn(self, found: Sequence[Sequence[str]]) -> None:
        """Solve the units that are not remembered yet, all at once."""
        if len(self.known) > self.remembered:
            self.known.clear()
        new = list({u for units in found for u in units}.difference(self.known))
        short = [u for u in new if len(u) <= _LONG]
        self.known.update(zip(short, self.solve(short), strict=True))
        self.known.update((u, np.array(self.trace(u, self.paths(u, 0, [0]), len(u)), np.int32).tobytes()) for u in new if len(u) > _LONG)

    def units(self, text: str) -> np.ndarray:
        """The ids of a marked text that starts and ends where every segmentation cuts."""
        found = _UNITS.findall(text)
        self.learn([found])
        return np.frombuffer(b"".join(map(self.known.__getitem__, found)), np.int32)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        found = [_UNITS.findall(marked(x)) for x in texts]
        self.learn(found)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int32) for units in found]

    # -- any stretch of text, from several states -------------------------------------------------

    def paths(self, text: str, origin: int, states: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """best[p, s]: the largest sum from the cut at origin - states[s] to p, and the last piece's length.

        Pieces that end at or before ``origin`` are not counted: they belong to the chunk before."""
        best, back = np.full((len(text) + 1, len(states)), -np.inf), np.zeros((len(text) + 1, len(states)), np.int8)
        for s, state in enumerate(states):
            if state <= origin:
                best[origin - state, s] = 0
        for end in range(origin + 1, len(text) + 1):
            for length in range(1, min(end, self.longest) + 1):
                found = self.table.get(text[end - length : end])
                if found is None and length > 1:
                    continue
                total = best[end - length] + (found[0] if found else self.cost(text[end - 1]))
                better = total > best[end]
                best[end, better], back[end, better] = total[better], length
        return best, back

    def trace(self, text: str, solved: tuple[np.ndarray, np.ndarray], end: int, column: int = 0, origin: int = 0) -> list[int]:
        back, ids = solved[1], []
        while end > origin:
            low = end - int(back[end, column])
            ids += reversed(self.spelled(text[low:end]))
            end = low
        return ids[::-1]

    def _parts(self, text: str, origin: int) -> tuple[int, int]:
        """First and last place behind ``origin`` that every segmentation cuts; (-1, -1) if there is none."""
        cuts = [m.start() for m in _CUT.finditer(text) if m.start() > origin]
        return (cuts[0], cuts[-1]) if cuts else (-1, -1)

    def matrix(self, text: str, origin: int) -> np.ndarray:
        """The chunk text[origin:] from any state at its start to any state at its end."""
        m = self.longest
        out, size = np.full((m, m), -np.inf), len(text)
        first, last = self._parts(text, origin)
        ends = [size - s for s in range(m)]
        if first < 0:
            best = self.paths(text, origin, range(m))[0]
            for s, end in enumerate(ends):
                if end >= 0:
                    out[:, s] = best[end]
            return out
        head = self.paths(text[:first], origin, range(m))[0][first]
        middle = float(self.weight_of[self.units(text[first:last])].sum())
        tail = self.paths(text[last:], 0, [0])[0][:, 0]
        for s, end in enumerate(ends):
            if end >= last:
                out[:, s] = head + middle + tail[end - last]
        return out

    def between(self, text: str, origin: int, start: int, stop: int) -> list[int]:
        """Ids of the pieces that end in text[origin:], from one state to another."""
        first, last = self._parts(text, origin)
        end = len(text) - stop
        if first < 0 or end < last:
            if end <= origin:  # one piece reaches over the whole chunk
                return []
            return self.trace(text, self.paths(text, origin, [start]), end, 0, origin)
        out = self.trace(text[:first], self.paths(text[:first], origin, [start]), first, 0, origin)
        out += self.units(text[first:last]).tolist()
        return out + self.trace(text[last:], self.paths(text[last:], 0, [0]), end - last)

    def decode(self, ids: np.ndarray) -> str:
        shown, out, raw = self.shown, [], bytearray()
        if not self.high[ids].any():
            out = [shown.get(i, "") for i in ids.tolist()]
        else:
            for i in ids.tolist():
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(shown.get(i, ""))
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ").removeprefix(" ")


def marked(text: str) -> str:
    """Spaces as marks, one in front; an empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product of stacks of matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def prefix_scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, in a logarithmic number of rounds."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = product(out[:-step], out[step:])
        step *= 2
    return out


def boundaries(matrices: np.ndarray) -> list[tuple[int, int]]:
    """The states at both ends of each chunk on a best path from state 0 to state 0."""
    before = prefix_scan(matrices)[:, 0, :]
    states = [0]
    for n in range(len(matrices) - 1, 0, -1):
        states.append(int((before[n - 1] + matrices[n][:, states[-1]]).argmax()))
    states.append(0)
    states.reverse()
    return list(zip(states[:-1], states[1:], strict=True))


def model_path(name: str = "piece_bpe_32k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.model")


def _lists(parts: Sequence[Sequence[int]]):
    """Arrow lists of 32-bit numbers."""
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    flat = np.concatenate([np.asarray(x, np.int32) for x in parts]) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _giants(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """(doc_id, text, ids) of giant texts, chunk by chunk."""
    import pyarrow as pa

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces(path).longest - 1
        for batch in batches:
            for key, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                name, whole = uuid.uuid4().hex, marked(text)
                for n, at in enumerate(range(0, len(whole), chunk)):
                    low = max(0, at - reach)
                    row = ([key], [name], [n], [whole[low : at + chunk]], [at - low])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names)

    names, kinds = ["doc_id", "name", "n", "chunk", "origin"], (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32())
    chunks = written(docs.mapInArrow(cut, "doc_id long, name string, n int, chunk string, origin int"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces(path).matrix(x, o).tobytes() for x, o in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["name", "n", "matrix"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        size = pieces(path).longest
        states = boundaries(np.stack([np.frombuffer(x, np.float64).reshape(size, size) for x in table.column("matrix").to_pylist()]))
        start, stop = zip(*states, strict=True)
        return pa.table([table.column("name"), table.column("n"), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["name", "n", "start", "stop"])

    dealt = chunks.select("name", "n", "chunk", "origin").repartition("name", "n")
    solved = dealt.mapInArrow(matrices, "name string, n int, matrix binary").groupBy("name").applyInArrow(join, "name string, n int, start int, stop int")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3, 7)]
            ids = [pieces(path).between(*x) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), _lists(ids)], ["doc_id", "name", "n", "ids"])

    parts = chunks.join(solved, ["name", "n"]).select("doc_id", "name", "n", "chunk", "origin", "start", "stop")
    parts = parts.mapInArrow(spell, "doc_id long, name string, n int, ids array<int>")
    whole = parts.groupBy("name").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("parts"))
    return whole.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids"))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, chunk: int = 1 << 16) -> DataFrame:
    """One row per document: doc_id and ids.

    A null or empty text has no ids.  Texts of more than ``chunk`` characters are encoded in chunks on
    many tasks; their ids meet in one row at the end.  Equal rows are encoded each for
    itself; extra columns are ignored; an empty table gives no rows.
    """
    import pyarrow as pa

    path = path or model_path()
    rows = common.columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    giant = F.length("text") > chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(pieces(path).encode(batch.column(1).to_pylist()))], ["doc_id", "ids"])

    return rows.filter(~giant).mapInArrow(run, "doc_id long, ids array<int>").unionByName(_giants(rows.filter(giant), path, chunk))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows with ``decoded``: spaces for marks, without the one in front; null ids give an empty text."""
    import pyarrow as pa

    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces(path).decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
