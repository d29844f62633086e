"""Centroid clustering over blocks of vectors in the order of a space-filling curve.

Vectors become whole numbers, so that sums, means and distances are exact and no order of
work can change a result.  They are sorted along a Hilbert curve through their widest components and written
as blocks of neighbours, each with a zone map: the least and greatest value of every component.  In each
round a task asks a block's box which centroids can be nearest to any vector in it.  With p the centroid nearest
to the middle of the box, the difference of the squared distances to c and to p is linear in the vector, so its
least value over the box is a sum over components; where that is positive, c is nearest to nothing in the
block.  The block's vectors are compared with the remaining centroids only, exactly.

Between rounds the driver holds the centroids and one row of sums per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import written

BLOCK = 64  # vectors in a block
LARGEST = 1 << 27  # components are clamped to this, so that a squared distance of 64 of them fits 63 bits


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below 2**bits; columns * bits is at most 63."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of the curve, coarse to fine
        low = (1 << level) - 1
        for i in range(n):
            set_ = (x[i] >> level) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> level) & 1)
    return place


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """[block, centroid]: whether the centroid can be nearest to a vector in the block's box."""
    twice = low + high
    to_middle = ((twice[:, None, :] - 2 * centroids[None]).astype(np.float64) ** 2).sum(2)
    pivot = to_middle.argmin(1)
    turn = centroids[pivot][:, None, :] - centroids[None]  # towards the pivot
    length = (centroids**2).sum(1)
    least = np.minimum(low[:, None, :] * turn, high[:, None, :] * turn).sum(2) * 2 + length[None] - length[pivot][:, None]
    return least <= 0


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid, the first of equal ones, and its squared distance."""
    if max(np.abs(vectors).max(), np.abs(centroids).max()) <= 1 << 22:  # all terms and sums are exact doubles
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        squares = ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    else:
        squares = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)
    at = squares.argmin(1)
    return at, squares[np.arange(len(at)), at]


@dataclass
class Assigner:
    """Nearest centroids of the vectors of blocks, found among each block's candidates."""

    centroids: np.ndarray
    together: int = 128  # blocks whose boxes are compared at once
    compared: int = 0
    possible: int = 0

    def of(self, batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(vectors, nearest centroid, squared distance) of each block."""
        width = self.centroids.shape[1]
        numbers = lambda name: [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, width).astype(np.int64) for x in batch.column(name)]
        low, high, blocks = np.concatenate(numbers("low")), np.concatenate(numbers("high")), numbers("v")
        for first in range(0, len(blocks), self.together):
            part = slice(first, first + self.together)
            for block, can in zip(blocks[part], candidates(low[part], high[part], self.centroids), strict=True):
                left = np.flatnonzero(can)
                at, squares = nearest(block, self.centroids[left])
                self.compared += len(left) * len(block)
                self.possible += len(can) * len(block)
                yield block, left[at], squares


def _whole(df: DataFrame, vec_id: str, vector: str, width: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of the right width without nulls and non-finite components, as whole numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    kept = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).filter(
        (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    fit = lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x * scale, F.lit(-1e15)), F.lit(1e15))), F.lit(LARGEST)), F.lit(-LARGEST))
    return kept.select("vec_id", F.transform("v", lambda x: fit(x).cast("int")).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _spread(points: DataFrame, width: int, outside: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Low and high quantile of each component over all rows, which far outliers leave as they are; approximate, as only the layout rests on them."""
    ends = F.array(F.lit(outside), F.lit(1 - outside))
    found = points.agg(*(F.percentile_approx(F.get("v", F.lit(i)), ends, 200).alias(f"q{i}") for i in range(width))).first()
    return tuple(np.array([q[side] for q in found], np.float64) for side in (0, 1))


def blocks_of(points: DataFrame, width: int, block: int = BLOCK, axes: int = 8, bits: int = 7) -> DataFrame:
    """(ids, v, low, high): blocks of neighbours on the curve, whole numbers as 32-bit bytes.

    The curve runs through the ``axes`` components with the widest span between two outer quantiles, each cut into 2**bits
    cells within that span.  Range parts hold even shares: equal vectors are told apart by their ids and then by a number per row.
    """
    import pyarrow as pa

    start, end = _spread(points, width)
    axis = np.sort(np.argsort(start - end, kind="stable")[: min(axes, width)])
    origin, step = start[axis], np.maximum(end[axis] - start[axis], 1.0) / (1 << bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width)
            cells = np.floor((v[:, axis] - origin) / step).clip(0, (1 << bits) - 1)
            raw = pa.array([r.tobytes() for r in v.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array(hilbert(cells, bits))], ["vec_id", "v", "place"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(1)), np.int32).reshape(-1, width)
            cuts = np.arange(0, len(v), block)
            ends = np.append(cuts[1:], len(v))
            low, high = np.minimum.reduceat(v, cuts), np.maximum.reduceat(v, cuts)
            ids = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(v)), pa.int32()), batch.column(0))
            raw = pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())
            boxes = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([ids, raw, *boxes], ["ids", "v", "low", "high"])

    on_curve = points.select("vec_id", "v").mapInArrow(place, "vec_id long, v binary, place long")
    dealt = on_curve.withColumn("salt", F.monotonically_increasing_id())
    ordered = dealt.repartitionByRange("place", "vec_id", "salt").sortWithinPartitions("place", "vec_id", "salt")
    return written(ordered.select("vec_id", "v").mapInArrow(gather, "ids array<long>, v binary, low binary, high binary"))


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple]:
    """(n, squares, sums, compared, possible) of each centroid with vectors; one row per centroid and task is shuffled."""
    import pyarrow as pa

    k, width = centroids.shape
    names = ["cluster", "n", "squares", "compared", "possible", *(f"s{i}" for i in range(width))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, squares, total = np.zeros(k, np.int64), np.zeros(k, object), np.zeros((k, width), np.int64)
        work = Assigner(centroids)
        for batch in batches:
            for block, at, square in work.of(batch) if batch.num_rows else ():
                n += np.bincount(at, minlength=k)
                np.add.at(total, at, block)
                for c in np.unique(at):
                    squares[c] += sum(square[at == c].tolist())
        some = np.flatnonzero(n)
        share = lambda x: pa.array([x if c == 0 else 0 for c in range(len(some))], pa.int64())
        exact = pa.array([str(squares[c]) for c in some], pa.string())
        columns = [pa.array(some), pa.array(n[some]), exact, share(work.compared), share(work.possible)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(total[some, i]) for i in range(width))], names)

    schema = ", ".join(f"{x} {'string' if x == 'squares' else 'long'}" for x in names)
    parts = blocks.mapInArrow(add, schema)
    exact = [F.sum(F.col(x).cast("decimal(28,0)")).alias(x) for x in names[1:]]
    return {r["cluster"]: (int(r["n"]), int(r["squares"]), [int(r[f"s{i}"]) for i in range(width)], int(r["compared"]), int(r["possible"])) for r in parts.groupBy("cluster").agg(*exact).collect()}


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    seed: int = 2,
    width: int = 64,
    scale: int = 256,
    block: int = BLOCK,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    report: list | None = None,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Vectors that are null, not ``width`` wide, or hold a null or non-finite component take no part.  Each
    component x becomes floor(scale * x), clamped to 2**27 either way.  The first centroids are the k vectors with the smallest
    sha256 of "seed:vec_id" (a null id reads as empty; rows that repeat an id by their components); fewer vectors than k are
    all centroids.  Repeated rows are rows of their own.  An inertia beyond 63 bits is null.  An empty table gives no rows; extra columns are ignored.
    ``report`` receives, per assignment, the distances computed and those a full comparison computes.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    points = _whole(vectors, vec_id, vector, width, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = points.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, width)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    blocks = blocks_of(points, width, block)
    for left in range(rounds, -1, -1):
        sums = _sums(blocks, centroids)
        if report is not None:
            report.append((sum(s[3] for s in sums.values()), sum(s[4] for s in sums.values())))
        if left:
            centroids = centroids.copy()
            for c, (n, _, total, _, _) in sums.items():
                centroids[c] = [s // n for s in total]
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda x: x if x < 1 << 63 else None
    inertia = fits(sum(s[1] for s in sums.values()))
    mine = [fits(sums[c][1]) if c in sums else 0 for c in range(len(centroids))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sized, named, work = pa.array(mine, pa.int64()), pa.array(shown), Assigner(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [(at, squares) for _, at, squares in work.of(batch)]
            at, squares = (np.concatenate(x) for x in zip(*found, strict=True))
            whole = pa.array([inertia] * len(at), pa.int64())
            columns = [batch.column("ids").flatten(), pa.array(at.astype(np.int32)), pa.array(squares), sized.take(pa.array(at)), whole, named.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(assign, schema)
