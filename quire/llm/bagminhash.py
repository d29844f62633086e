"""Near-duplicates of multisets by BagMinHash.

A document is the multiset of its five-word shingles.  Each shingle with count w carries
Poisson processes over its weight: the weight axis is cut at 0, 1, 2, 4, 8, ...; each interval has
one process whose rate is its length, and a point of an interval that w covers in part is located
in it by halving and kept if it lies below w.  Every point falls on one of the signature's
registers, which keep their first point.  Two documents agree in a register with a
probability of exactly sum(min) / sum(max) of their counts, the weighted Jaccard
similarity.  Points are drawn in the order of time and only until all registers are filled.

Bands of registers give buckets.  All members of a bucket are compared with one of them, and linked ones
form components.  What is left in a bucket between different components is compared pair by
pair, in crowded buckets by blocks whose overlaps are one matrix product.  Every
comparison is the exact multiset overlap of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.graph import components
from quire.sources.scratch import written

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of every shingle of ``width`` words."""
    parts = [(x or "").encode("utf-8", "replace") + b" " for x in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    space = _SPACES[data]
    step = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, stops = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    words = common.substring_hashes(common.prefix_sums(data), starts, stops)
    owner = np.searchsorted(ends, starts, side="right")
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        hashes += common.mixed(words[k : k + n], k + 1)
    whole = owner[:n] == owner[width - 1 :]
    return owner[:n][whole], common.mixed(hashes[whole])


def counted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, count) of each distinct pair, by owner and hash."""
    if not len(owner):
        return owner, hashes, np.zeros(0, np.int64)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))))
    return owner[new], hashes[new], np.diff(np.append(new, len(owner)))


def _intervals(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, length) of the weight intervals that each weight reaches into."""
    rows, low, length = [np.arange(len(weights))], [np.zeros(len(weights), np.int64)], [np.ones(len(weights), np.int64)]
    bound = 1
    while len(reach := np.flatnonzero(weights > bound)):
        rows.append(reach)
        low.append(np.full(len(reach), bound))
        length.append(np.full(len(reach), bound))
        bound *= 2
    return np.concatenate(rows), np.concatenate(low), np.concatenate(length)


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers identities of first points; rows without shingles stay 0."""
    out = np.zeros((n, registers), np.uint64)
    weight = np.bincount(owner, weights=counts, minlength=n)
    todo = np.flatnonzero(weight)
    limit = np.zeros(n)
    limit[todo] = registers * (np.log(registers) + 5) / weight[todo]
    while len(todo):
        chosen = np.isin(owner, todo) if len(todo) < n else np.ones(len(owner), bool)
        o, h, w = owner[chosen], hashes[chosen], counts[chosen]
        row, low, length = _intervals(w)
        o, top = o[row], w[row] - low
        seed = common.mixed(h[row] + common.mixed(low.astype(np.uint64), 3))
        time, draw = np.zeros(len(row)), 0
        points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(o):
            draw += 1
            bits = common.mixed(seed + np.uint64(draw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), 5)
            time = time - np.log(((bits >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / length
            on = time <= limit[o]
            o, top, length, seed, time, bits = o[on], top[on], length[on], seed[on], time[on], bits[on]
            more = common.mixed(bits, 9)
            inside = (more >> np.uint64(20)).astype(np.int64) & (length - 1) < top  # lengths are powers of two
            place = o[inside] * registers + ((more[inside] & np.uint64(0xFFFFF)).astype(np.int64) * registers >> 20)
            points.append((place, time[inside], common.mixed(more[inside], 11)))
        place, time, name = (np.concatenate(x) for x in zip(*points, strict=True))
        order = np.argsort(-time, kind="stable")
        out.reshape(-1)[place[order]] = name[order]
        filled = np.zeros(n * registers, bool)
        filled[place] = True
        todo = todo[~filled.reshape(n, registers)[todo].all(axis=1)]
        limit[todo] *= 2
    return out


def _band_rows(width: int, bands: int, rows: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                owner, hashes, counts = counted(*shingles(batch.column(1).to_pylist(), width))
                found = signatures(owner, hashes, counts, batch.num_rows, bands * rows).reshape(-1, bands, rows)
                key = np.zeros(found.shape[:2], np.uint64)
                for k in range(rows):
                    key = common.mixed(key + found[:, :, k], k + 1)
                key = common.mixed(key + np.arange(bands, dtype=np.uint64), 13)
                has = np.bincount(owner, minlength=batch.num_rows) > 0
                flat, offsets = key[has].reshape(-1).view(np.int64), np.concatenate(([0], np.cumsum(has * bands))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["node", "keys"])

    return run


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two counted multisets (sorted hashes, counts)."""
    (x, m), (y, n) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    shared = int(np.minimum(m[hit], n[at[hit]]).sum())
    return shared / (int(m.sum()) + int(n.sum()) - shared)


def _compare(width: int, threshold: float):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bag = None, None
        for batch in batches:
            a, b, linked = [], [], []
            for center, node, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                mine = counted(*shingles([text], width))[1:]
                if node == center:  # sorted so that it stands before its members
                    of, bag = center, mine
                elif of == center:
                    a.append(node), b.append(center), linked.append(overlap(mine, bag) >= threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float, members: int) -> DataFrame:
    """(a, b, linked) for pairs of a node a with a center b.

    A center's pairs are dealt in shares of about ``members`` rows; the center's text
    goes along with each share, so no center is too large for a task.
    """
    centers = pairs.groupBy(F.col("b").alias("center")).agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("shares"))
    own = centers.select("center", F.col("center").alias("node"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    theirs = pairs.join(centers, pairs["b"] == centers["center"]).select(
        "center", F.col("a").alias("node"), F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share")
    )
    rows = own.unionByName(theirs).join(texts, "node").withColumn("other", F.col("node") != F.col("center"))
    dealt = rows.repartition("center", "share").sortWithinPartitions("center", "share", "other")
    return dealt.select("center", "node", "text").mapInArrow(_compare(width, threshold), "a long, b long, linked boolean")


def linked_pairs(texts: list[str], group: np.ndarray, width: int, threshold: float, columns: int = 4096) -> list[tuple[int, int]]:
    """Pairs of texts of different groups with a similarity of ``threshold`` or more, as far as they join groups.

    All overlaps at once: a copy of a shingle is a column of a 0-1 matrix, whose product with itself
    counts shared copies; columns that only one text has are left out, the others taken in parts."""
    owner, hashes, counts = counted(*shingles(texts, width))
    size = np.bincount(owner, weights=counts, minlength=len(texts))
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(owner, counts)
    _, column, many = np.unique(common.mixed(np.repeat(hashes, counts) + common.mixed(copy.astype(np.uint64), 3)), return_inverse=True, return_counts=True)
    shared = many[column] > 1
    column = (np.cumsum(many > 1) - 1)[column[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(texts), len(texts)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [low, low + columns])
        part = np.zeros((len(texts), columns), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    either = size[:, None] + size[None, :] - both
    hit = (both > 0) & (both >= threshold * either - 1e-6) & (group[:, None] < group[None, :])
    out, parent = [], {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(hit), strict=True):
        p, q = top(int(group[i])), top(int(group[j]))
        if p != q:
            parent[q] = p
            out.append((int(i), int(j)))
    return out


def _compared_blocks(at: DataFrame, texts: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """(a, b) links between the components in each bucket.

    A bucket's members are dealt into blocks, and each pair of blocks is compared in one task, so
    that a bucket of any size takes bounded memory and no pair becomes a row unless it is a link."""
    import pyarrow as pa

    sizes = at.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = at.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "node", "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    )

    def compare(table: pa.Table) -> pa.Table:
        node, group = table.column("node").to_numpy(), table.column("component").to_numpy()
        pairs = linked_pairs(table.column("text").to_pylist(), group, width, threshold) if len(set(group.tolist())) > 1 else []
        a, b = ([int(node[p[k]]) for p in pairs] for k in range(2))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.join(texts, "node").groupBy("key", "x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 5,
    members: int = 512,
    crowd: int = 32,
    block: int = 512,
) -> DataFrame:
    """One row per document: doc_id, copy_of (smallest id with the same text), class_id (smallest id of its class),
    print (MD5 of the text).

    A class is a connected component of links; equal texts are linked, and so are texts whose
    shingle multisets have a weighted Jaccard similarity of ``threshold`` or more (a
    pair right at 0.8 is missed with a probability below 4e-6 for the default bands).  A null
    text counts as empty.  Texts of fewer than ``width`` words have no shingles and are linked to
    equal texts only.  A null id has no class of its own: it takes that of an equal text, or null.  Rows that
    repeat an id are one document.  Extra columns are ignored; an empty table gives no rows.
    """
    source = common.columns(docs, node=doc_id, text=text).select(F.col("node").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    marked = source.withColumn("print", F.unhex(F.md5("text")))
    same = written(marked.groupBy("print").agg(F.min("node").alias("copy_of")))
    first = written(same.filter(F.col("copy_of").isNotNull()).select(F.col("copy_of").alias("node")).distinct())
    keys = written(source.mapInArrow(_band_rows(width, bands, rows), "node long, keys array<long>").filter(F.size("keys") > 0))
    in_band = keys.join(first, "node", "left_semi").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    buckets = in_band.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    inside = written(in_band.join(buckets, "key"))
    wanted = written(inside.select("node").distinct())
    texts = written(source.join(wanted, "node").dropDuplicates(["node"]))

    # Every member with one member of its bucket, the same one in all buckets where it can be.
    center = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))
    heads = inside.groupBy("key").agg(center.alias("c")).select("key", F.col("c.node").alias("b"))
    pairs = inside.join(heads, "key").select(F.col("node").alias("a"), "b").filter("a != b").distinct()
    done = written(_verified(pairs, texts, width, threshold, members))
    links = done.filter("linked").select("a", "b")
    labels = components(links)
    # What is left: buckets of three or more that are not together yet.  Small ones pair by pair, once each; crowds by blocks.
    at = inside.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = at.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count(F.lit(1)).alias("n"))
    at = written(at.join(sizes.filter("p < q and n > 2").select("key", "n"), "key"))
    if not at.isEmpty():
        few = at.filter(F.col("n") <= crowd)
        x, y = (few.select("key", F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("a", "p"), ("b", "q")))
        known = done.select("a", "b").unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rest = written(x.join(y, "key").filter("p < q").select("a", "b").distinct().join(known, ["a", "b"], "left_anti"))
        more = _verified(rest, texts, width, threshold, members).filter("linked").select("a", "b")
        crowds = _compared_blocks(at.filter(F.col("n") > crowd).select("key", "node", "component"), texts, width, threshold, block)
        links = written(links.unionByName(more).unionByName(crowds))
        labels = components(links)
    out = marked.select(F.col("node").alias("doc_id"), "print").join(same, "print").join(labels, F.col("copy_of") == labels["node"], "left")
    return out.select("doc_id", "copy_of", F.coalesce("component", "copy_of").alias("class_id"), "print")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each class: the one with the smallest id.

    Rows without an id stay once for each text that no row with an id has.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    key = F.col(f"`{doc_id}`")
    first = found.filter(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_first")).distinct()
    kept = docs.filter(key.isNotNull()).join(first, key.cast("long") == F.col("_first"), "left_semi").dropDuplicates([doc_id])
    alone = found.filter("doc_id is null and class_id is null").select(F.col("print").alias("_print")).distinct()
    unnamed = docs.filter(key.isNull()).withColumn("_print_of", F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    unnamed = unnamed.join(alone, F.col("_print_of") == F.col("_print"), "left_semi").dropDuplicates(["_print_of"]).drop("_print_of")
    return kept.unionByName(unnamed)
