"""Quality rules with a divergence test, in DataFrame functions only.

Counts of each document (words, symbols, repeated lines, repeated five-word windows) give
the plain rules.  Beyond these, the histogram of a document's character classes and that of its common
words and all others are compared with references, which are the summed histograms of all documents that
state the same language and pass the plain rules.  The distance is Jensen and Shannon's (square
root of the divergence with base 2: 0 alike, 1 disjoint); short documents are not
judged by it, as their histograms are mostly noise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.sources.scratch import written

# White space between words, and the symbols counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
PLAIN = r"[a-z\x20]+"
# Character classes that are counted beside these two; what is left over is plain letters.
CLASSES = {"upper": r"\p{Lu}+", "digit": r"[0-9]+", "point": r"[.,;:!?'\"()\-]+", "wide": r"[^\x00-\x7F]+"}
# Frequent words of four languages.
COMMON = (
    "the of and to in is that it for was with as on be at by this from are not "
    "der die und das den von zu mit sich des ist im dem nicht ein eine als auch "
    "le la les et des un une est que qui dans pour du sur par au "
    "el los las y en que se del por con una para es lo"
).split()
COMMON = tuple(dict.fromkeys(COMMON))


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _window_hashes(words: Column, n: Column, width: int) -> Column:
    window = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width)))
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), window)).otherwise(F.array().cast("array<bigint>"))


def _covered(places: Column, width: int) -> Column:
    """Length of the union of [p, p + width) over sorted places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda a, p: F.struct((a["n"] + p + width - F.greatest(p, a["end"])).alias("n"), (p + width).alias("end"))
    return F.aggregate(places, start, add, lambda a: a["n"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", width: int = 5) -> DataFrame:
    """doc_id, lang ('' if null), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the
    histograms ``chars`` and ``words`` (one bin for each common word, then all others).  A null text counts as empty."""
    df = common.columns(docs, doc_id=doc_id, text=text, lang=lang)
    df = df.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    t, w = F.col("t"), F.col("w")
    df = df.withColumns({"w": F.array_remove(F.split(t, SPACE), ""), "lines": _lines(t)})
    df = df.withColumns({"n": F.size(w), "common": F.array_join(F.filter(F.transform(w, F.lower), lambda x: x.isin(*COMMON)), "  ")})
    df = df.withColumn("h", _window_hashes(w, F.col("n"), width))
    h, s = F.col("h"), F.col("s")
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("s", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, F.get(s, F.greatest(i - 1, F.lit(0)))) & (i > 0) | same(x, F.get(s, i + 1)))
    repeated = F.when(s.isNotNull(), _covered(F.sort_array(F.transform(twice, lambda x: x["i"])), width)).otherwise(0)
    total = F.length(t)
    # Plain small letters and blanks are in no class below: the patterns go over what stands between them.
    df = df.withColumn("odd", _without(t, PLAIN))
    odd = F.col("odd")
    left = {"word": F.length(F.array_join(w, ""))}
    left |= {k: F.length(odd) - F.length(_without(odd, p)) for k, p in {"symbol": SYMBOLS, **CLASSES}.items()}
    df = df.withColumns({f"c_{k}": x for k, x in left.items()} | {"total": total, "repeated": repeated, "padded": F.concat(F.lit(" "), "common", F.lit(" "))})
    named = ["symbol", *CLASSES]
    rest = F.col("c_word") - sum((F.col(f"c_{k}") for k in named), F.lit(0))
    chars = F.array(*(F.col(f"c_{k}").cast("double") for k in named), (F.col("total") - F.col("c_word")).cast("double"), F.greatest(rest, F.lit(0)).cast("double"))
    p = F.col("padded")
    counts = [((F.octet_length(p) - F.octet_length(F.replace(p, F.lit(f" {x} "), F.lit("")))) / (len(x.encode()) + 2)) for x in COMMON]
    return df.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.col("c_word").cast("long").alias("word_chars"),
        F.col("c_symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeated").cast("long").alias("n_repeat_words"),
        chars.alias("chars"),
        F.array(*counts, F.col("n") - sum(counts, F.lit(0.0))).alias("words"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same length; null if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    part = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)

    def of(sums: Column) -> Column:
        p1, q1 = F.transform(p, lambda x: x / sums["p"]), F.transform(q, lambda x: x / sums["q"])
        each = F.zip_with(p1, q1, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
        return F.when((sums["p"] > 0) & (sums["q"] > 0), F.sqrt(F.greatest(total(each) / (2 * math.log(2)), F.lit(0.0))))

    # The totals are an element of an array, so that they are summed once and not for each bin.
    return F.transform(F.array(F.struct(total(p).alias("p"), total(q).alias("q"))), of)[0]


def quality(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    least_words: int = 10,
    repeat_percent: int = 20,
    judged_words: int = 50,
    most_chars: float = 0.3,
    most_common: float = 0.25,
    short_common: float = 1.75,
) -> DataFrame:
    """One row per document: the counts, base_failed, char_distance, word_distance and kept.

    Distances are judged from ``judged_words`` words on, that of words against ``most_common`` and
    ``short_common`` / n_words more, as few words lie far by chance.  They are null where a
    histogram or its reference is empty; a null distance never rejects.  Documents
    without a language share one reference.  Rows with equal ids are judged each for itself;
    extra columns are ignored; an empty table gives no rows.
    """
    found = features(docs, doc_id, text, lang)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    found = written(found.withColumn("base_failed", failed))
    places = {"chars": len(CLASSES) + 3, "words": len(COMMON) + 1}
    sums = [F.array(*(F.sum(F.col(k)[i]) for i in range(n))).alias(f"all_{k}") for k, n in places.items()]
    reference = written(found.filter(~F.col("base_failed")).groupBy("lang").agg(*sums))
    compared = found.join(reference, "lang", "left").withColumns(
        {
            "char_distance": distance(F.col("chars"), F.col("all_chars")),
            "word_distance": distance(F.col("words"), F.col("all_words")),
            "n_common": F.aggregate(F.slice("words", 1, len(COMMON)), F.lit(0.0), lambda a, x: a + x),
        }
    )
    far = (F.col("char_distance") > most_chars) | (F.col("word_distance") > most_common + short_common / F.col("n_words"))
    unlike = (F.col("n_words") >= judged_words) & F.coalesce(far, F.lit(False))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return compared.select(*counts, (~F.col("base_failed") & ~unlike).alias("kept"), "char_distance", "word_distance", "n_common")
