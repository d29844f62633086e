"""Language identification by a linear-chain conditional random field over words.

A word's score for a language is the sum of learned weights of its trigrams (with marks at both
ends), of its four-letter prefix and suffix and of the word itself (the lexicon), all hashed to a
table.  Learned transitions tie neighbouring words together, so that a stray word
follows its surroundings while a real switch of language does not.  Forward-backward gives
each word's probability of each language; a document's language is the one with most
letters, weighted by these probabilities.

The field is fitted in the driver on a bounded sample: at most ``per_language`` documents for each of
at most ``most_languages`` languages, cut into runs of words that are shuffled into code-switched
sequences, with Adagrad on the conditional likelihood, from naive Bayes weights as a start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common

_LETTERS: list[np.ndarray] = []
_ROWS = 512  # texts labelled side by side


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


@dataclass
class Words:
    """Words of a batch of texts: where each belongs, its letters, and its features' table rows."""

    owner: np.ndarray
    size: np.ndarray
    single: np.ndarray  # words x 3: prefix, suffix, lexicon
    grams: np.ndarray  # of all words, one after the other
    ends: np.ndarray  # of each word in grams


def words_of(texts: Sequence[str | None], bits: int) -> Words:
    """Runs of letters, lower case."""
    parts = [f"  {x.lower()}  " if x else "    " for x in texts]
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[chars]
    step = np.diff(letter.astype(np.int8))
    starts, stops = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    owner = np.searchsorted(np.cumsum([len(p) for p in parts]), starts, side="right")
    code = np.where(letter, chars, 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - bits)
    row = lambda x, salt: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt) >> shift).astype(np.int32)
    two = code[:-1] * np.uint64(3) + (code[1:] ^ (code[1:] >> np.uint64(31)))
    three = two[:-1] * np.uint64(5) + (code[2:] >> np.uint64(7))
    four = three[:-1] * np.uint64(7) + (code[3:] >> np.uint64(11))
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(common.mixed(code) * common._powers(common._ODD, len(chars)), out=sums[1:])
    whole = (sums[stops] - sums[starts]) * common._powers(common._INVERSE, len(chars))[starts]
    single = np.stack([row(four[starts - 1], 1), row(four[np.maximum(stops - 3, 0)], 2), row(common.mixed(whole), 3)], axis=1) if len(starts) else np.zeros((0, 3), np.int32)
    # Trigrams from the mark before the word to the one behind it: one for each letter.
    size = stops - starts
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - 1 - (ends - size), size)
    return Words(owner, size, single, row(three[at], 0), ends)


def words_in_parts(texts: Sequence[str | None], bits: int, most: int) -> Iterator[Words]:
    """``words_of`` for stretches of about ``most`` characters, which bounds the memory it takes."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < most):
            size += len(texts[stop] or "")
            stop += 1
        part = words_of(texts[start:stop], bits)
        part.owner += start
        yield part
        start = stop


@dataclass
class Field:
    languages: list[str]
    bits: int
    weights: np.ndarray  # table rows x languages
    moves: np.ndarray  # log weights of transitions

    def scores(self, w: Words) -> np.ndarray:
        """Words x languages."""
        out = self.weights[w.single[:, 0]] + self.weights[w.single[:, 1]] + self.weights[w.single[:, 2]]
        if len(w.ends):
            out += np.add.reduceat(self.weights[w.grams], w.ends - w.size, axis=0)
        return out


def forward_backward(
    field: Field, scores: np.ndarray, lengths: np.ndarray, learn: bool = False, block: int = 512
) -> tuple[np.ndarray, np.ndarray | None]:
    """Probabilities of the languages of each word, and when learning the expected transitions.

    scores: words of sequences of the given lengths, one after the other.  Sequences are cut into
    blocks; what a block does to any state before it is a small matrix, and the product of
    these gives every block's state at both ends, so that all blocks of a batch run side by
    side, however long one text is."""
    k = len(field.moves)
    if not len(scores):
        return np.zeros((0, k)), np.zeros((k, k))
    emit = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0))
    move = np.exp(field.moves - field.moves.max())
    lengths = lengths[lengths > 0]
    per = -(-lengths // block)
    head = np.cumsum(per) - per  # of each sequence, its first block
    place = np.arange(per.sum()) - np.repeat(head, per)
    begin = np.repeat(np.cumsum(lengths) - lengths, per) + place * block
    size = np.minimum(np.repeat(lengths, per) - place * block, block)
    enter, leave = np.full((len(size), k), 1.0 / k), np.full((len(size), k), 1.0 / k)
    even = lambda x: x / x.sum(axis=-1, keepdims=True)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    steps = range(int(size[0]))
    active = np.searchsorted(-size, -np.arange(len(steps)), side="left")  # blocks longer than t
    if per.max() > 1:
        some = np.flatnonzero(np.repeat(per > 1, per)[order])  # a sequence of one block needs no matrix
        some_begin, some_active = begin[some], np.searchsorted(some, active)
        now = np.tile(np.eye(k), (len(some), 1, 1))
        for t in steps:
            n = some_active[t]
            onward = (now[:n].reshape(-1, k) @ move).reshape(n, k, k) * emit[some_begin[:n] + t][:, None, :]
            now[:n] = onward / onward.sum(axis=(1, 2), keepdims=True)
        does = np.empty((len(size), k, k))
        does[order[some]] = now
        for j in range(1, int(per.max())):
            at = head[per > j] + j
            enter[at] = even(np.einsum("ni,nij->nj", enter[at - 1], does[at - 1]))
            back = (head + per)[per > j] - j - 1  # from the end
            leave[back] = even(np.einsum("nij,nj->ni", does[back + 1], leave[back + 1]))
    enter, leave = enter[order], leave[order]
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    now = enter
    for t in steps:
        at = begin[: active[t]] + t
        now = even((now[: len(at)] @ move) * emit[at])
        alpha[at] = now
    for t in reversed(steps):
        n, m = active[t], active[t + 1] if t + 1 < len(steps) else 0
        at = begin[:n] + t
        now = leave[:n].copy()
        if m:
            now[:m] = even((emit[at[:m] + 1] * beta[at[:m] + 1]) @ move.T)
        beta[at] = now
    if not learn:
        return even(alpha * beta), None
    inner = np.ones(len(emit), bool)
    inner[np.cumsum(lengths) - 1] = False
    inner = np.flatnonzero(inner)
    joint = alpha[inner][:, :, None] * move[None] * (emit * beta)[inner + 1][:, None, :]
    return even(alpha * beta), (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit(texts: Sequence[str], labels: Sequence[str], bits: int = 16, rounds: int = 4, parts: int = 6, seed: int = 5) -> Field:
    """A field from documents in one language each."""
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    k, rows = len(languages), 1 << bits
    gold_of = np.array([number[x] for x in labels], np.int64)
    parted = list(words_in_parts(texts, bits, 1 << 18))
    w = Words(*(np.concatenate([getattr(p, name) for p in parted]) for name in ("owner", "size", "single", "grams")), np.zeros(0))
    w.ends = np.cumsum(w.size)
    rng = np.random.default_rng(seed)
    # Runs of 4 to 40 words of one document, in random order: sequences of code-switched text.
    n = len(w.owner)
    cuts = np.unique(np.concatenate((np.flatnonzero(np.diff(w.owner)) + 1, np.cumsum(rng.integers(4, 41, size=max(1, n // 12))), [0])))
    cuts = cuts[cuts < n]
    runs = np.stack([cuts, np.append(cuts[1:], n)], axis=1)[rng.permutation(len(cuts))]
    gold = gold_of[w.owner]
    counts = np.zeros((rows, k))
    gram_gold = np.repeat(gold, w.size)
    for c in range(k):
        counts[:, c] = np.bincount(w.grams[gram_gold == c], minlength=rows) + sum(np.bincount(w.single[gold == c, j], minlength=rows) for j in range(3))
    rate = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * rows))
    seen = counts.sum(axis=1, keepdims=True) > 0
    field = Field(languages, bits, np.where(seen, 0.2 * (rate - rate.mean(axis=1, keepdims=True)), 0.0), np.full((k, k), -2.0) + 2.0 * np.eye(k))
    power, power_moves = np.full((rows, k), 1e-2), np.full((k, k), 1.0)
    for _ in range(rounds):
        for share in np.array_split(rng.permutation(len(runs)), parts):
            if not len(share):
                continue
            chosen = [np.arange(a, b) for a, b in runs[share]]
            words = np.concatenate(chosen)
            ends = np.cumsum([len(c) for c in chosen])
            lengths = np.diff(np.concatenate(([0], ends[7::8], ends[-1:])))  # eight runs a sequence
            lengths = lengths[lengths > 0]
            size = w.size[words]
            stops = np.cumsum(size)
            at = np.arange(stops[-1]) + np.repeat((w.ends - w.size)[words] - (stops - size), size)
            part = Words(w.owner[words], size, w.single[words], w.grams[at], stops)
            post, expected = forward_backward(field, field.scores(part), lengths, learn=True)
            gap = post
            gap[np.arange(len(words)), gold[words]] -= 1
            slope = np.empty((rows, k))
            wide = np.repeat(gap, size, axis=0)
            for c in range(k):
                slope[:, c] = np.bincount(part.grams, wide[:, c], rows) + sum(np.bincount(part.single[:, j], gap[:, c], rows) for j in range(3))
            slope += 1e-3 * len(words) / n * field.weights
            power += slope**2
            field.weights -= 0.15 * slope / np.sqrt(power)
            inner = np.ones(len(words), bool)
            inner[np.cumsum(lengths) - 1] = False
            true = np.zeros((k, k))
            np.add.at(true, (gold[words][inner], gold[words][np.flatnonzero(inner) + 1]), 1)
            slope_moves = expected - true
            power_moves += slope_moves**2
            field.moves -= 0.3 * slope_moves / np.sqrt(power_moves)
    field.weights = field.weights.astype(np.float32)
    return field


def label(field: Field, texts: Sequence[str | None], most: int = 1 << 18) -> Iterator[tuple[str | None, float, list[dict]]]:
    """For each text its language (None without a letter), the score and the runs of words by language."""
    if not texts:
        return
    owners, sizes, scores = [], [], []
    for w in words_in_parts(texts, field.bits, most):
        owners.append(w.owner), sizes.append(w.size), scores.append(field.scores(w))
    owner, size, score = np.concatenate(owners), np.concatenate(sizes), np.concatenate(scores).astype(np.float64)
    lengths = np.bincount(owner, minlength=len(texts))
    post, _ = forward_backward(field, score, lengths)
    share = np.stack([np.bincount(owner, post[:, c] * size, len(texts)) for c in range(len(field.languages))], axis=1)
    best = post.argmax(axis=1)
    ends = np.cumsum(lengths)
    for i, (total, end) in enumerate(zip(share.sum(axis=1), ends, strict=True)):
        if not lengths[i]:
            yield None, 0.0, []
            continue
        mine = best[end - lengths[i] : end]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(mine)) + 1, [len(mine)]))
        runs = [{"lang": field.languages[mine[a]], "words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        top = int(share[i].argmax())
        yield field.languages[top], min(1.0, float(share[i, top] / total)), runs


def training_rows(docs: DataFrame, held_out: Column, per_language: int, most_languages: int) -> list[tuple[str, str]]:
    """(text, lang) of the ids with the smallest hashes of each language, whole texts; an id counts once, by its first text."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()]
    hashed = (F.xxhash64("doc_id"), F.col("doc_id"))
    first = lambda df, *keys: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*hashed))).filter(F.col("n") <= per_language).drop("n")
    ids = rows.filter(F.col("lang").isin(known)).select("lang", "doc_id").distinct()
    # First in 64 parts of each language, so that a language's last ranking sees at most 64 * per_language ids.
    chosen = first(first(ids.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))), "lang", "part"), "lang").drop("part")
    # At most per_language * most_languages ids; the texts are looked up by them.
    some = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    found = some.orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect()
    return [(r["text"], r["lang"]) for r in found]


def learned_field(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 200, most_languages: int = 64, bits: int = 16
) -> Field | None:
    """The field fitted on the documents that are not held out; None if there is nothing to learn from."""
    rows = common.columns(docs, doc_id=doc_id, text=text, lang=lang)
    learned = training_rows(rows, F.coalesce(held_out(F.col("doc_id")), F.lit(True)), per_language, most_languages)
    return fit([t for t, _ in learned], [x for _, x in learned], bits) if learned else None


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def identify(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    unknown: str = "und",
    per_language: int = 200,
    most_languages: int = 64,
    bits: int = 16,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, runs (language and number of words, in order).

    The field learns from stated languages of documents with crc32(doc_id as text) mod 3 other than 1 (a null id counts as
    neither learned from nor held out) and predicts from the text alone.  ``unknown`` with score 0 is returned for texts that are null or
    without a letter, and for all if there is nothing to learn from.  Rows with equal ids are labelled each for
    itself; extra columns are ignored; an empty table gives no rows.
    """
    rows = common.columns(docs, doc_id=doc_id, text=text)
    field = learned_field(docs, doc_id, text, lang, per_language, most_languages, bits)

    import pyarrow as pa

    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                texts = batch.column(2).to_pylist()
                found = list(label(field, texts)) if field else [(None, 0.0, [])] * len(texts)
                names, scores, runs = zip(*found, strict=True)
                columns = [pa.array([x or unknown for x in names]), pa.array(scores, pa.float64()), pa.array(runs, kind)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "runs"])

    given = rows.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, runs array<struct<lang:string,words:int>>")


def keep_identified(docs: DataFrame, least: float = 0.4, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **bounds: int) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text has letters and one language with a share of at least ``least``.

    Without anything to learn from no text is rejected but those without a letter.
    """
    field = learned_field(docs, doc_id, text, lang, **bounds)
    place = docs.columns.index(text)

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                texts = batch.column(place).to_pylist()
                if field:
                    good = [score >= least for _, score, _ in label(field, texts)]
                else:
                    good = [any(map(str.isalpha, t or "")) for t in texts]
                yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
