"""Log probability of documents: a lattice of subwords with learned words among its arcs.

A document is its words, each led by a space mark, and an end.  A word's lattice has an arc for every
vocabulary piece that stands in it, weighted by the vocabulary's existing score, and arcs of single
bytes, so that every text has a path.  Its probability is the sum over all segmentations, by a forward recursion in log
space.  No piece reaches across a space mark, so a document's marginal is the product of those of its words, and each different
word's lattice is summed once.  What is learned from the training documents is one more arc over each known word, with a share
of the mass in proportion to its count.

Frequent words (a bounded number) are looked up where the text is read; the others are joined by
word and summed by document.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import pieces
from quire.sources.scratch import written

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_INNER = "\ue000"  # stands for a space mark inside a word: as many bytes, and no piece holds it
_LOADED: dict[str, "Lattice"] = {}


class Lattice:
    """Normalised log weights of a vocabulary's pieces, of a byte and of the end of a text."""

    def __init__(self, path: str):
        known = pieces.Pieces(path)
        top = max(w for w, _ in known.table.values())
        mass = sum(math.exp(w) for w, _ in known.table.values()) + 256 * math.exp(known.byte_weight) + math.exp(top)
        self.weight = {piece: w - math.log(mass) for piece, (w, _) in known.table.items() if _INNER not in piece}
        self.byte, self.end = known.byte_weight - math.log(mass), top - math.log(mass)
        # By every start of a piece: the weight, or nothing where the start is no piece itself.
        self.starts: dict[str, float | None] = {piece[:n]: None for piece in self.weight for n in range(2, len(piece))}
        self.starts |= {piece: w for piece, w in self.weight.items() if len(piece) > 1}
        self.chars: dict[str, float] = {}  # a character as a piece or as bytes

    def char(self, char: str) -> float:
        spelled = self.byte * len(char.encode("utf-8", "replace"))
        both = _added(self.weight[char], spelled) if char in self.weight else spelled
        if len(self.chars) < 1 << 16:
            self.chars[char] = both
        return both

    def of(self, word: bytes) -> float:
        """Natural log of the sum over all segmentations; of the end, if the word is empty."""
        if not word:
            return self.end
        text = pieces.MARK + word.decode("utf-8", "replace").replace(pieces.MARK, _INNER)
        size, starts, chars = len(text), self.starts, self.chars
        nothing = -math.inf
        ahead = array("d", [nothing]) * (size + 1)
        ahead[0] = 0.0
        for i in range(size):
            here, char = ahead[i], text[i]
            arc = chars.get(char)
            new = here + (self.char(char) if arc is None else arc)
            old = ahead[i + 1]
            ahead[i + 1] = new if old == nothing else _added(old, new)
            for j in range(i + 2, size + 1):
                arc = starts.get(text[i:j], 0.0)
                if arc is None:
                    continue
                if arc == 0.0:  # no piece starts like this; weights are below 0
                    break
                old, new = ahead[j], here + arc
                ahead[j] = new if old == nothing else _added(old, new)
        return ahead[size]


def _added(a: float, b: float) -> float:
    """Log of the sum; a term below the other's last digit changes nothing."""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b - a > -40.0 else a


def lattice(path: str) -> Lattice:
    if path not in _LOADED:
        _LOADED[path] = Lattice(path)
    return _LOADED[path]


def words_of(text: bytes, stretch: int) -> Iterator[list[bytes]]:
    """Words of a text with small letters for A to Z, in stretches that end between words."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + stretch)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def _vocabulary(rows: DataFrame, path: str, stretch: int, held: int = 200_000) -> DataFrame:
    """(word, n, c, inside): count of every word in all texts and in training, and its lattice's log sum; the end is the empty word."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, training = Counter(), Counter()

        def taken() -> pa.RecordBatch:
            words = list(every)
            out = [pa.array(words, pa.binary()), pa.array(every.values(), pa.int64()), pa.array([training[w] for w in words], pa.int64())]
            every.clear(), training.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "n", "c"])

        for batch in batches:
            for text, out in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                every[b""] += 1
                training[b""] += not out
                for words in words_of(text.as_buffer().to_pybytes(), stretch):
                    every.update(words)
                    if not out:
                        training.update(words)
                    if len(every) > held:
                        yield taken()
        yield taken()

    def sum_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = lattice(path)
        for batch in batches:
            inside = pa.array([sums.of(w) for w in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, inside], ["word", "n", "c", "inside"])

    counted = rows.select("t", "held_out").mapInArrow(count, "word binary, n long, c long")
    whole = counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return written(whole.mapInArrow(sum_paths, "word binary, n long, c long, inside double"))


def score(
    docs: DataFrame,
    path: str | None = None,
    learned: float = 0.9,
    head: int = 100_000,
    widest: int = 64,
    stretch: int = 1 << 22,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Rows whose crc32 of the id modulo 10 is 0 are held out (a null id reads as empty, so it is); the others are learned from,
    repeated rows as often as they stand.  A null or empty text is its end alone.  ``base_score`` is the smoothed word
    model's log10 probability, ``score`` that of the lattice, whose learned arcs have the share ``learned`` of the mass (none of
    it where nothing was learned).  Counts cover all rows and whole texts.  The ``head`` most frequent words of at most ``widest`` bytes, and
    nothing else that grows, go to the driver and all tasks.  An empty table gives no rows; extra columns are ignored.
    """
    import pyarrow as pa

    path = path or pieces.model_path()
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("t"))
    rows = rows.withColumn("held_out", held_out)
    words = _vocabulary(rows, path, stretch)
    tokens, different = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    below = tokens + 0.1 * (different + 1)
    least = F.lit(math.log(1 - learned) if tokens else 0.0) + F.col("inside")
    most = F.when(F.col("c") > 0, F.ln(F.col("c") * (learned / max(tokens, 1))))
    high = F.greatest(least, most)  # the other one, if there is no learned arc
    both = F.when(F.col("c") > 0, high + F.log1p(F.exp(F.least(least, most) - high))).otherwise(least)
    words = words.select("word", "n", "c", F.log10((F.col("c") + 0.1) / below).alias("base"), (both / math.log(10)).alias("score"))
    frequent = words.filter(F.length("word") <= widest).orderBy(F.desc("n"), "word").limit(head).collect()
    near = {bytes(r["word"]): (r["c"] > 0, r["base"], r["score"]) for r in frequent}
    names = ["row", "doc_id", "held_out", "word", "n", "known", "base", "score"]
    schema = "row long, doc_id long, held_out boolean, word binary, n long, known long, base double, score double"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        held = []

        def taken() -> pa.RecordBatch:
            out = [pa.array(c, k) for c, k in zip(zip(*held, strict=True) if held else [[]] * len(kinds), kinds, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            for row, i, t, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                n = known = 0
                base = total = 0.0
                for part in _counted(t.as_buffer().to_pybytes(), stretch):
                    for word, times in part.items():
                        found = near.get(word)
                        if found is None:
                            held.append((row, None, None, word, times, None, None, None))
                            continue
                        n += times
                        known += times if found[0] else 0
                        base += times * found[1]
                        total += times * found[2]
                    if len(held) > 50_000:
                        yield taken()
                held.append((row, i, out, None, n, known, base, total))
        yield taken()

    # Row numbers hold as they are written here, once, with the rows that bear them.
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "t", "held_out")
    parts = written(numbered.mapInArrow(read, schema))
    rare = parts.filter(F.col("word").isNotNull()).select("row", "word", "n").join(words.drop("n"), "word")
    none = F.lit(None)
    times = F.col("n")
    rare = rare.select(
        "row", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), "n",
        F.when(F.col("c") > 0, times).otherwise(0).alias("known"), (times * F.col("base")).alias("base"), (times * F.col("score")).alias("score"),
    )
    sums = parts.filter(F.col("word").isNull()).drop("word").unionByName(rare).groupBy("row")
    out = sums.agg(*(F.max(c).alias(c) for c in ("doc_id", "held_out")), *(F.sum(c).alias(c) for c in ("n", "known", "base", "score")))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )


def _counted(text: bytes, stretch: int) -> Iterator[Counter]:
    """Words and their counts, stretch by stretch; the end comes last."""
    for words in words_of(text, stretch):
        yield Counter(words)
    yield Counter([b""])
