"""Resampling, clustering and scoring against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import lattice, pieces, queries, resample, zones

SF = "/root/testdata/sf0.001"
ODD_ROWS = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "Été AbC 12"), (5, "Été AbC 12"), (5, "other"), (None, "a b"), (None, "a b"), (6, "x" * 30_000), (7, "the cat " * 9000)]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- resampling --------------------------------------------------------------------------------


def test_crc_of_spans():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    sizes = np.array([1, 2, 3, 4, 63, 64, 65, 127, 128, 129, 1000, 8191, 16_000, *rng.integers(1, 200, 300)])
    starts = np.array([rng.integers(0, len(data) - n + 1) for n in sizes])
    got = resample.crc32_of(data, starts, starts + sizes)
    assert got.tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, sizes, strict=True)]
    assert len(resample.crc32_of(data, starts[:0], starts[:0])) == 0


def plain_resample(docs, target, percent, least_words, most, buckets, seed):
    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    s, t = (Counter(b for text in texts for b in runs(text)[1]) for texts in ([d[1] for d in docs], target))
    whole, aimed = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (whole + buckets)) / ((s[b] + 1) * (aimed + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, found = runs(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, words])
    fit = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): n for n, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted((tuple(r[:4]) + (drawn.get(id(r)),) for r in rows), key=repr)


def test_resampling_query(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    want = plain_resample([(r["doc_id"], r["text"]) for r in read("documents")], [r["text"] for r in read("benchmark")], 10, 20, 1, 10_000, 2024)
    got = queries.QUERIES["op11_resampling"](spark, SF)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize(("most", "stretch"), [(1, 1 << 20), (3, 1 << 20), (3, 50)])
def test_resampling_edges(spark, most, stretch):
    docs = spark.createDataFrame(ODD_ROWS, "doc_id long, text string").withColumns({"t": F.lit(1), "rank": F.lit(2), "score": F.lit(3), "n_words": F.lit(4)})
    target = spark.createDataFrame([("the cat sat",), (None,), ("",)], "text string")
    got = resample.resample(docs, target, percent=100, least_words=1, most=most, buckets=97, stretch=stretch).drop("n_words")
    want = plain_resample(ODD_ROWS, ["the cat sat", None, ""], 100, 1, most, 97, 2024)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame(ODD_ROWS, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, docs).collect() == []
    assert resample.resample(docs, none).count() == len(ODD_ROWS)


# ---- clustering --------------------------------------------------------------------------------


def plain_cluster(rows, k, rounds, seed, width, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assigned():
        points, c = np.array([v for _, v in kept], object), np.array(centroids, object)
        squares = ((points[:, None] - c[None]) ** 2).sum(2)
        at = squares.argmin(1)
        return at, squares[range(len(at)), at]

    for _ in range(rounds):
        at, _ = assigned()
        for c in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at, squares = assigned()
    own = Counter()
    for a, s in zip(at, squares, strict=True):
        own[a] += s
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, int(a), s, own[a], sum(own.values()), shown[a]) for (i, _), a, s in zip(kept, at, squares, strict=True)), key=repr)


def test_curve_is_a_walk():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * axes)).reshape(axes, -1).T
        place = zones.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_clustering_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.QUERIES["op12_clustering"](spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_cluster(rows, 40, 5, 2, 64)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_clustering_edges(spark, block):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 4 * 3, 0.3) for _ in range(5)]) for i in range(300)]
    rows += [(7, [0.0] * 5)] * 60 + [(None, [1.0] * 5)] * 2 + [(400, None), (401, [1.0] * 4), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [float("nan")] * 5), (404, [float("inf")] * 5), (405, [300_000.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "key", "place", "ids", "cluster")})
    report = []
    got = zones.cluster(df.repartition(3), k=6, rounds=3, width=5, block=block, report=report)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_cluster(rows, 6, 3, 2, 5)
    compared, possible = map(sum, zip(*report, strict=True))
    assert compared < 0.6 * possible  # clustered vectors: the boxes rule out centroids


def test_clustering_of_nothing_and_few(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert zones.cluster(df.limit(0), width=2).collect() == []
    assert sorted(r["distance"] for r in zones.cluster(df, width=2).collect()) == [0, 0]


def test_huge_components_are_clamped(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in zones.cluster(df, k=1, rounds=0, width=2).collect()}
    assert len(found) == 3 and all(r["distance"] >= 0 for r in found.values())


# ---- scoring -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sums():
    return lattice.lattice(pieces.model_path())


def paths(sums, text, at=0):
    """Probabilities of all segmentations of text[at:], one by one."""
    if at == len(text):
        yield 1.0
        return
    for end in range(at + 1, len(text) + 1):
        piece = text[at:end]
        here = math.exp(sums.weight[piece]) if piece in sums.weight else 0.0
        if end == at + 1:
            here += math.exp(sums.byte * len(piece.encode()))
        if here:
            yield from (here * rest for rest in paths(sums, text, end))


@pytest.mark.parametrize("word", ["a", "the", "segments", "überall", "3.14", "\U0001f600", "x" * 12])
def test_sum_over_all_segmentations(sums, word):
    assert sums.of(word.encode()) == pytest.approx(math.log(sum(paths(sums, "▁" + word))), abs=1e-9)


def test_weights_are_a_distribution(sums):
    assert sum(map(math.exp, sums.weight.values())) + 256 * math.exp(sums.byte) + math.exp(sums.end) == pytest.approx(1)
    assert sums.of(b"") == sums.end and math.isfinite(sums.of("▁▁a".encode())) and math.isfinite(sums.of(b"x" * 100_000))


def plain_scores(rows, sums, learned=0.9):
    split = lambda text: [*re.findall(r"[^\x20\x09-\x0D]+", lowered(text)), ""]
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    c = Counter(w for i, text in rows if crc(i) for w in split(text))
    n = sum(c.values())
    out = []
    for i, text in rows:
        words = split(text)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in words)
        total = 0.0
        for w, times in Counter(words).items():
            path, own = sums.of(w.encode()), learned * c[w] / n if n else 0.0
            rest = path + (math.log(1 - learned) if n else 0.0)
            total += times * (np.logaddexp(rest, math.log(own)) if own else rest) / math.log(10)
        out.append((i, crc(i) == 0, len(words), sum(c[w] > 0 for w in words), n, base, total))
    return sorted(out, key=repr)


def same_scores(got, want):
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert sorted(r[k] for r in got) == pytest.approx(sorted(r[k] for r in want), rel=1e-9)


def test_scoring_query(spark, sums):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_lm_scoring"](spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    same_scores(got, plain_scores(rows, sums))


@pytest.mark.parametrize(("head", "widest", "stretch"), [(0, 64, 1 << 22), (3, 2, 10), (100_000, 64, 1)])
def test_scoring_edges(spark, sums, head, widest, stretch):
    docs = spark.createDataFrame(ODD_ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("t", "row", "word", "n", "score", "held_out")})
    same_scores(lattice.score(docs.repartition(3), head=head, widest=widest, stretch=stretch), plain_scores(ODD_ROWS, sums))


def test_scoring_of_nothing_learned(spark, sums):
    held = [(i, "some words here") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame(held, "doc_id long, text string")
    same_scores(lattice.score(df), plain_scores(held, sums))
    assert lattice.score(df.limit(0)).collect() == []


def test_shuffled_letters_score_lower(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 400").limit(40).collect()]
    rng = random.Random(2)
    mixed = [(10_000 + i, "".join(rng.sample(t, len(t)))) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lattice.score(df.unionByName(spark.createDataFrame(mixed, df.schema))).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0 or zlib.crc32(str(10_000 + i).encode()) % 10 == 0]
    assert held and all(both[i] > both[10_000 + i] for i in held if zlib.crc32(str(10_000 + i).encode()) % 10 == 0)
