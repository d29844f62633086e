"""Approximate nearest neighbours by probed lists and an adaptive scan of dimensions.

Centroids are fitted on a bounded sample; every vector goes to the list of its nearest
centroid.  A query probes the lists whose centroids are nearest to it.  Lists are dealt
into cells of bounded size, vectors by queries, so that a list of any size is shared by many tasks.

In a cell, vectors and queries are turned by a random rotation, after which the share of a squared
distance that d of D dimensions hold has mean d / D and variance 2 d (D - d) / (D^2 (D + 2)).  The scan
adds up blocks of columns and, after each, drops the candidates whose distance so far is more than
``sigmas`` deviations too large for a vector as near as the k-th best known.  That bound comes
from the candidates that look best after a block, which are measured to the end, and, in all lists but a query's
nearest ones, from what those have shown before: they are scanned first, and their bound is joined in.
What survives is measured exactly on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common
from quire.sources.scratch import written


def rotation(size: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = squared(x, centers).argmin(1)
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def scan(x: np.ndarray, query: np.ndarray, k: int, step: int, sigmas: float, bound: float = math.inf) -> tuple[np.ndarray, int]:
    """Places in rotated ``x`` that may be among the k nearest to the rotated query and within the squared
    distance ``bound``, and the number of components read."""
    size = x.shape[1]
    slack = 1e-12 * float(query @ query) + 1e-30  # of rounding: near ties are measured exactly later
    alive, far, read = np.arange(len(x)), np.zeros(len(x)), 0
    for d in range(0, size, step):
        part = x[alive, d : d + step] - query[d : d + step]
        far = far + np.einsum("ij,ij->i", part, part)
        seen = min(d + step, size)
        read += part.size
        if seen < size and len(alive) >= (k if bound == math.inf else 16 * k):  # the k that look best now are at most this far
            first = np.argpartition(far, k - 1)[:k]
            rest = x[alive[first], seen:] - query[seen:]
            bound = min(bound, float((far[first] + np.einsum("ij,ij->i", rest, rest)).max()))
            read += rest.size
        share = seen / size + sigmas * math.sqrt(2 * seen * (size - seen) / (size + 2)) / size
        on = far <= bound * min(1.0, share) * (1 + 1e-9) + slack
        alive, far = alive[on], far[on]
        if not len(alive):
            break
    if len(alive) > k:
        bound = min(bound, float(np.partition(far, k - 1)[k - 1]))
        alive = alive[far <= bound * (1 + 1e-9) + slack]
    return alive, read


def _vectors(table, column: str) -> np.ndarray:
    data = table.column(column).combine_chunks()
    return np.array(data.flatten(), dtype=np.float64).reshape(len(data), -1)


def nearest(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    sample: int = 20_000,
    most_lists: int = 4096,
    probe: float = 0.65,
    least_probes: int = 8,
    cell_vectors: int = 8192,
    cell_queries: int = 512,
    step: int = 8,
    sigmas: float = 2.0,
    lead: float = 0.125,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, nearest first; compared and read: the
    vectors in the lists the query probed, and how many of their components were read.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those with the
    query's id.  score is the Euclidean distance of the original vectors in double precision, ties
    go to the smaller id.  Rows with a null id, and vectors that are null, zero, hold a null or
    non-finite component, or have another length than most, take no part.  Rows that
    repeat an id are candidates each for itself and one query (the smallest vector).  Extra columns are ignored; an empty table gives no rows.

    The centroids are fitted on the ``sample`` rows with the smallest hashes of their ids;
    there are sqrt(rows) lists, up to ``most_lists``, of which a query probes the share ``probe``, and more while
    these hold fewer than k candidates.  The share ``lead`` of those, the nearest, are scanned before the others.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    rows = common.columns(vectors, id=vec_id, v=embedding).select(F.col("id").cast("long"), v.cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double, compared long, read long"
    if not sizes:
        return spark.createDataFrame([], schema)
    size, total = sizes[0]["size"], sizes[0]["n"]
    rows = rows.filter(F.size("v") == size)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    turn = rotation(size)
    centers = kmeans(_vectors(some, "v") @ turn, max(1, min(most_lists, math.isqrt(total))))

    import pyarrow as pa

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(pa.Table.from_batches([batch]), "v") @ turn
                near = np.concatenate([squared(x[i : i + 1024], centers).argmin(1) for i in range(0, len(x), 1024)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], ["id", "v", "list"])

    listed = written(rows.mapInArrow(assign, "id long, v array<double>, list int"))
    held = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    filled = np.array([held.get(i, 0) for i in range(len(centers))])
    probes = max(least_probes, math.ceil(probe * len(centers)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                order = squared(_vectors(pa.Table.from_batches([part]), "v") @ turn, centers).argsort(1, kind="stable")
                short = np.cumsum(filled[order], axis=1) - filled[order] < k + 1  # lists that are needed to have k candidates
                place = np.arange(len(centers))
                row, at = np.nonzero((short | (place < probes)) & (filled[order] > 0))
                begins = (short | (place < max(1, lead * probes)))[row, at]
                columns = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(order[row, at].astype(np.int32)), pa.array(begins)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "list", "begins"])

    one_each = listed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(one_each.mapInArrow(choose, "id long, v array<double>, list int, begins boolean"))
    asks = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [(i, math.ceil(n / cell_vectors), math.ceil(asks[i] / cell_queries)) for i, n in held.items() if i in asks]
    grid = F.broadcast(spark.createDataFrame(plan, "list int, blocks int, chunks int"))  # one row per list, at most most_lists
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = listed.join(grid, "list").select("list", "id", "v", mine("blocks").alias("block"), each("chunks").alias("chunk"))
    names, kinds = ["query_id", "vec_id", "score", "compared", "read"], (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of each query, and a row without a vector that says what was read."""
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            ids, x, asking, q = left.column("id").to_numpy(), _vectors(left, "v"), right.column("id").to_numpy(), _vectors(right, "v")
            bounds = right.column("bound").to_numpy()
            xt, qt = x @ turn, q @ turn
            for i, one in enumerate(asking):
                places, read = scan(xt, qt[i], k + int((ids == one).sum()), step, sigmas, bounds[i])
                places = places[ids[places] != one]
                score = np.sqrt(((x[places] - q[i]) ** 2).sum(1))
                best = np.lexsort((ids[places], score))[:k]
                n = len(best)
                rows = ([one] * (n + 1), [*ids[places[best]], None], [*score[best], None], [None] * n + [len(x)], [None] * n + [read])
                for target, values in zip(out, rows, strict=True):
                    target.extend(values)
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    def scanned(questions: DataFrame) -> DataFrame:
        dealt = questions.join(grid, "list").select("list", "id", "v", "bound", mine("chunks").alias("chunk"), each("blocks").alias("block"))
        key = ["list", "block", "chunk"]
        types = "query_id long, vec_id long, score double, compared long, read long"
        return written(data.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(cell, types))

    def best_of(found: DataFrame) -> DataFrame:
        nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
        some = found.filter(F.col("vec_id").isNotNull()).select("query_id", "vec_id", "score")
        return some.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k)

    first = scanned(asked.filter("begins").withColumn("bound", F.lit(math.inf)))
    known = best_of(first).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), (F.col("score") * F.col("score")).alias("known"))
    later = asked.filter(~F.col("begins")).join(written(known), "id", "left").withColumn("bound", F.coalesce("known", F.lit(math.inf)))
    found = first.unionByName(scanned(later))
    work = found.groupBy("query_id").agg(F.sum("compared").alias("compared"), F.sum("read").alias("read"))
    return best_of(found).join(work, "query_id").select("query_id", "rank", "vec_id", "score", "compared", "read")
