"""Removal of long repeated byte strings with a sparse, range-partitioned suffix array.

A byte string of ``length`` bytes that occurs twice is found through one anchor inside it: the
leftmost smallest hash among its half-length substrings, which depends on the string alone.  So
not all suffixes are needed, only those that start at anchors, about one in fifty.

1. Anchors of every text, with the hash of the half-length string that starts there and the hash
   of all bytes that a window through the anchor can cover (its context).
2. Anchors whose leading string occurs nowhere else are dropped.  Anchors whose context
   occurs twice are settled: every window through them is repeated.
3. One anchor per distinct context goes on with its bytes, if its leading string stands in several contexts.
   Sampled splitters range-partition these suffixes by their leading bytes, so that
   suffixes which agree in them never lie on two sides of a boundary.  Each bucket sorts its suffixes, and the reversed
   bytes before them, by multikey quicksort over 8-byte words.  Two windows are equal if
   their suffixes agree far enough to the right and far enough to the left, which the common prefix
   lengths of neighbours in the two orders tell for all offsets; bytes are compared, not hashes.
4. A crowd of anchors with one leading string would meet in one bucket whole, so its windows go one by one
   instead, each as two hashes of all its bytes; what occurs twice in a batch is settled
   there, and one of each different window goes on to the buckets.
5. The covered stretches of a text are merged and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common
from quire.sources.scratch import written

_ALL = 2**31 - 1


# ---- anchors ---------------------------------------------------------------------------------


def _slices(keys, texts, length: int, most: int) -> Iterator[tuple[list, list, list[bytes], list[tuple[int, int]]]]:
    """Batches of about ``most`` bytes: (keys, offsets, bytes, (first, last + 1) window starts).

    A text longer than that comes in slices with enough bytes around them that each window
    and its anchor's context lie in one slice whole.
    """
    out: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for key, text in zip(keys, texts, strict=True):
        data = text.encode("utf-8", "replace")
        for at in range(0, max(1, len(data) - length + 1), most):
            low, high = max(0, at - length), min(len(data), at + most + 2 * length)
            part = data[low:high]
            for x, y in zip(out, (key, low, part, (at - low, min(at + most, len(data) - length + 1) - low)), strict=True):
                x.append(y)
            size += len(part)
            if size >= most:
                yield out
                out, size = ([], [], [], []), 0
    if out[0]:
        yield out


def anchors(parts: Sequence[bytes], windows: Sequence[tuple[int, int]], length: int):
    """(place of the part, position in it, hash of the leading string, hash of the context)."""
    lead = length // 2
    span = length - lead + 1  # leading strings in a window
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    if len(data) < length:
        return none
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    sums = common.prefix_sums(data)
    at = np.arange(len(data) - lead + 1)
    hashes = common.substring_hashes(sums, at, at + lead)
    least = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)  # smallest, then leftmost
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    inside = np.zeros(len(least) + 1, np.int32)
    for begin, (first, last) in zip(begins, windows, strict=True):
        if last > first:
            inside[begin + first] += 1
            inside[begin + last] -= 1
    found = (least[np.cumsum(inside[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(found):
        return none
    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    part = np.searchsorted(ends, found, side="right")
    low, high = np.maximum(found - (length - lead), begins[part]), np.minimum(found + length, ends[part])
    context = common.mixed(common.substring_hashes(sums, low, high) + common.mixed(((found - low) * 1000003 + high - found).astype(np.uint64), 17))
    return part, found - begins[part], hashes[found], context


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _anchor_rows(length: int, size: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))  # one of each text
            for keys, offsets, parts, windows in _slices(texts.keys(), texts.values(), length, size):
                part, position, lead, context = anchors(parts, windows, length)
                key, position = np.array(keys, np.int64)[part], position + np.array(offsets, np.int64)[part]
                # Pre-aggregation: a context seen twice here is settled, and one row of it goes on.
                order = np.lexsort((position, key, context, lead))
                order = order[_new(key[order], position[order])]  # slices of one text may share an anchor
                key, position, lead, context = key[order], position[order], lead[order], context[order]
                first = np.append(_new(lead, context), True)
                state = np.where(~first[:-1], 1, np.where(~first[1:], 2, 0)).astype(np.int32)
                group = np.cumsum(_new(lead)) - 1
                many = np.bincount(group, first[:-1])[group] > 1  # contexts of the leading string, here
                columns = (lead.view(np.int64), context.view(np.int64), key, position, state, many)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lead", "context", "key", "position", "state", "many"])

    return run


# ---- suffixes --------------------------------------------------------------------------------


def multikey_quicksort(words: np.ndarray, small: int = 256) -> np.ndarray:
    """The order of the rows of a matrix, compared column by column."""
    order, n = np.arange(len(words)), words.shape[1]
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == n:
            continue
        part = order[low:high]
        if high - low <= small:
            order[low:high] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        column = words[part, depth]
        pivot = np.sort(column[[0, len(part) // 2, len(part) - 1]])[1]
        less, equal = column < pivot, column == pivot
        a = low + int(less.sum())
        b = a + int(equal.sum())
        order[low:high] = np.concatenate((part[less], part[equal], part[~(less | equal)]))
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _matrix(parts: Sequence[bytes], width: int) -> np.ndarray:
    data = b"".join(p[:width].ljust(width, b"\0") for p in parts)
    return np.frombuffer(data, dtype=np.uint8).reshape(len(parts), width)


def _order(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of byte rows, and how long each agrees with the one before it."""
    width = -(-chars.shape[1] // 8) * 8
    padded = np.zeros((len(chars), width), np.uint8)
    padded[:, : chars.shape[1]] = chars
    order = multikey_quicksort(padded.view(">u8").astype(np.uint64))
    common_length = np.zeros(len(chars), np.int64)
    for at in range(1, len(chars), 65536):
        here, before = chars[order[at : at + 65536]], chars[order[at - 1 : at - 1 + len(order[at : at + 65536])]]
        unlike = here != before
        common_length[at : at + 65536] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), chars.shape[1])
    return order, common_length


def repeated_windows(lefts: Sequence[bytes], rights: Sequence[bytes], low: int, high: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the smallest and largest offset i in [low, high] such that the window which
    starts i bytes before it equals that of another anchor; (high + 1, -1) if there is none.

    lefts: bytes before the anchor, nearest first."""
    n = len(rights)
    first, last = np.full(n, high + 1), np.full(n, -1)
    left_size, right_size = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    forward, agree = _order(_matrix(rights, length))
    backward, agree_left = _order(_matrix(lefts, max(high, 1)))
    right_class, left_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(low, high + 1):
        fits = np.flatnonzero((left_size >= i) & (right_size >= length - i))
        if len(fits) < 2:
            continue
        right_class[forward] = np.cumsum(agree < length - i)
        left_class[backward] = np.cumsum(agree_left < i)
        both = right_class[fits] * (n + 1) + left_class[fits]
        order = np.argsort(both, kind="stable")
        next_same = both[order][1:] == both[order][:-1]
        hit = fits[order[np.concatenate(([False], next_same)) | np.concatenate((next_same, [False]))]]
        first[hit] = np.minimum(first[hit], i)
        last[hit] = i
    return first, last


_OTHER = np.random.default_rng(4).permutation(256).astype(np.uint8)  # bytes under other names, for a second hash


def window_hashes(parts: Sequence[bytes], places: Sequence[int], length: int):
    """Windows through the anchors at ``places`` of ``parts``, by the offset at which they start before them.

    (anchor, offset, 16 bytes of hash) of one of each different window, and for each anchor the smallest and
    largest offset whose window occurs twice in these parts; (length + 1, -1) if there is none."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    offsets = np.arange(length - length // 2 + 1)
    start = (begins + np.array(places))[:, None] - offsets
    fits = (start >= begins[:, None]) & (start + length <= ends[:, None])
    anchor, offset = np.nonzero(fits)
    start = start[fits]
    a, b = (common.substring_hashes(common.prefix_sums(x), start, start + length) for x in (data, _OTHER[data]))
    order = np.lexsort((b, a, offset))
    anchor, offset, a, b = anchor[order], offset[order], a[order], b[order]
    new = np.append(_new(offset, a, b), True)
    twice = ~new[:-1] | ~new[1:]
    first, last = np.full(len(parts), length + 1), np.full(len(parts), -1)
    np.minimum.at(first, anchor[twice], offset[twice])
    np.maximum.at(last, anchor[twice], offset[twice])
    one = new[:-1]
    return anchor[one], offset[one], np.stack((a[one], b[one]), axis=1), first, last


def _contexts(length: int, most: int = 4000):
    """Rows with the bytes around an anchor; for one of a crowd a row (no ``before``) with the hash of each of
    its windows instead, and one (no ``after`` either) with the offsets that are settled here."""
    import pyarrow as pa

    reach = length - length // 2

    def hashed(crowd: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
        key, at = (np.array([x[i] for x in crowd], np.int64) for i in (0, 1))
        anchor, offset, hashes, first, last = window_hashes([x[2] for x in crowd], [x[3] for x in crowd], length)
        done = np.flatnonzero(last >= 0)
        which, none = np.concatenate((anchor, done)), pa.nulls(len(done), pa.binary())
        values = [hashes[i].tobytes() for i in range(len(hashes))]
        salted = common.mixed(key[done].view(np.uint64) + at[done].astype(np.uint64), 5).tobytes()  # any place will do
        low, high = np.concatenate((offset, first[done])), np.concatenate((offset, last[done]))
        leading = pa.array(values + [salted[8 * i : 8 * i + 8] for i in range(len(done))], pa.binary())
        after = pa.concat_arrays([pa.array(values, pa.binary()), none])
        arrays = [pa.array(key[which]), pa.array(at[which]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*arrays, leading, pa.nulls(len(which), pa.binary()), after], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd: list[tuple[int, int, bytes, int]] = []
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for key, text, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode("utf-8", "replace")
                for x in found:
                    at, from_ = x["position"], max(0, x["position"] - reach)
                    if x["crowd"]:
                        crowd.append((key, at, data[from_ : at + length], at - from_))
                        if len(crowd) >= most:
                            yield hashed(crowd)
                            crowd = []
                        continue
                    before, after = data[from_:at][::-1], data[at : at + length]
                    for out, value in zip(rows, (key, at, 0, reach, after[: length - reach], before, after), strict=True):
                        out.append(value)
                if len(rows[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names)
                    rows = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names)
        if crowd:
            yield hashed(crowd)

    names = ["key", "position", "low", "high", "leading", "before", "after"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return run


def _bucket(length: int):
    import pyarrow as pa

    def spans(key, first, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(first), pa.array(last + length)], ["key", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        whole = rows.column("before").is_valid()
        some = rows.filter(whole)
        if some.num_rows:
            first, last = repeated_windows(some.column("before").to_pylist(), some.column("after").to_pylist(), 0, length - length // 2, length)
            hit = last >= 0
            key, at = some.column("key").to_numpy()[hit], some.column("position").to_numpy()[hit]
            yield spans(key, at - last[hit], at - first[hit])
        rest = rows.filter(rows.column("before").is_null())
        done = rest.filter(rest.column("after").is_null())
        if done.num_rows:
            key, at, first, last = (done.column(c).to_numpy() for c in ("key", "position", "low", "high"))
            yield spans(key, at - last, at - first)
        single = rest.filter(rest.column("after").is_valid())
        if single.num_rows:
            hashes = np.frombuffer(b"".join(single.column("after").to_pylist()), np.uint64).reshape(-1, 2)
            key, at, offset = (single.column(c).to_numpy() for c in ("key", "position", "low"))
            order = np.lexsort((hashes[:, 1], hashes[:, 0], offset))
            new = np.append(_new(offset[order], hashes[order, 0], hashes[order, 1]), True)
            hit = order[~new[:-1] | ~new[1:]]
            yield spans(key[hit], at[hit] - offset[hit], at[hit] - offset[hit])

    schema = pa.schema([("key", pa.int64()), ("position", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])
    return run


# ---- the whole -------------------------------------------------------------------------------


def merged(spans: Sequence[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The union of spans, clipped to [0, size), as maximal runs."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((max(0, a), min(b, size)) for a, b in spans):
        if start >= end:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def whole_characters(runs: Sequence[tuple[int, int]], data: bytes) -> list[tuple[int, int]]:
    """Runs without the characters that they cover in part."""
    out = []
    for start, end in runs:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while start < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append((start, end))
    return [(a, b) for a, b in out if a < b]


def _cut(as_text: bool):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, at, kept, removed = text.encode("utf-8", "replace"), 0, [], 0
                runs = merged([(s["from"], s["to"]) for s in spans or ()], len(data))
                if as_text:
                    runs = whole_characters(runs, data)
                for start, end in runs:
                    kept.append(data[at:start])
                    removed += end - start
                    at = end
                left = b"".join([*kept, data[at:]])
                for out, x in zip(rows, (len(data), removed, len(runs), left.decode() if as_text else left), strict=True):
                    out.append(x)
            arrays = [batch.column(k) for k, n in enumerate(batch.schema.names) if n not in ("text", "spans")]
            names = [n for n in batch.schema.names if n not in ("text", "spans")]
            arrays += [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", carried: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """One row per row of ``docs``: the ``carried`` columns, n_bytes, n_removed, n_spans, kept.

    Every byte of a string of ``length`` bytes that also starts anywhere else is removed, in the same text
    or another row's; equal rows remove each other whole.  A null text counts as empty; texts shorter than
    ``length`` bytes stay.  ``kept`` holds the bytes left, concatenated, which may cut through a character.
    The windows of more than ``crowd`` (an option) different contexts of one leading string are told apart
    by two 64-bit hashes each.  Texts are told apart by a 64-bit hash.  Columns that are not
    carried are ignored; carried ones may have any name but those above.  An empty table gives no rows.
    """
    return _removed(docs, text, carried, **options).withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carried)})


def cut_texts(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeats cut out of the text, but for characters that they cover in part.

    All columns and rows stay; a null text becomes empty."""
    out = _removed(docs, text, [c for c in docs.columns if c != text], as_text=True, **options)
    place = iter(f"_c{i}" for i in range(len(docs.columns)))
    return out.select(*(F.col("kept" if c == text else next(place)).alias(c) for c in docs.columns))


def _removed(
    docs: DataFrame, text: str, carried: Sequence[str], length: int = 200, crowd: int = 200_000, slice_bytes: int = 2 << 20, as_text: bool = False
) -> DataFrame:
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carried)), value.alias("text"), F.xxhash64(value).alias("key"))
    found = written(base.select("key", "text").mapInArrow(_anchor_rows(length, slice_bytes), "lead long, context long, key long, position long, state int, many boolean"))

    by_lead, by_context = Window.partitionBy("lead"), Window.partitionBy("lead", "context")
    unlike = lambda c, w: F.min(c).over(w) < F.max(c).over(w)
    several = lambda w: unlike("key", w) | unlike("position", w) | (F.max("state").over(w) > 0)
    firsts = found.filter("state != 1")
    # A leading string of many contexts has several of them in one batch nearly always; the others are counted by nobody.
    crowds = written(firsts.filter("many").groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("lead"))
    here = firsts.join(crowds, "lead", "left_anti").repartition("lead").withColumns(
        {"settled": several(by_context), "turn": F.row_number().over(by_context.orderBy("key", "position"))}
    )
    here = here.withColumns({"shared": several(by_lead), "mixed": unlike("context", by_lead)}).filter("shared")
    here = written(here.select("key", "position", "settled", (F.col("mixed") & (F.col("turn") == 1)).alias("goes")))

    goes = here.filter("goes").select("key", "position", F.lit(False).alias("crowd"))
    goes = goes.unionByName(firsts.join(crowds, "lead", "left_semi").select("key", "position", F.lit(True).alias("crowd")))
    wanted = goes.groupBy("key").agg(F.collect_set(F.struct("position", "crowd")).alias("found"))
    once = wanted.join(base, "key").dropDuplicates(["key"])
    contexts = once.select("key", "text", "found").mapInArrow(
        _contexts(length), "key long, position long, low int, high int, leading binary, before binary, after binary"
    )
    dealt = contexts.repartitionByRange("low", "leading").select("key", "position", "low", "high", "before", "after")
    compared = dealt.mapInArrow(_bucket(length), "key long, from long, to long")

    reach = length - length // 2
    settled = here.filter("settled").select("key", "position").unionByName(found.filter("state > 0").select("key", "position"))
    settled = settled.select("key", (F.col("position") - reach).alias("from"), (F.col("position") + length).alias("to"))
    copies = base.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size"))
    copies = copies.filter((F.col("n") > 1) & (F.col("size") >= length)).select("key", F.lit(0).cast("long").alias("from"), F.lit(_ALL).cast("long").alias("to"))
    spans = compared.unionByName(settled).unionByName(copies).groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    joined = base.join(spans, "key", "left").drop("key")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name.startswith("_c"))
    return joined.mapInArrow(_cut(as_text), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
