"""Personal data by candidates and boosted trees, in DataFrame functions only.

Strict rules give the base spans.  Looser generators propose more spans, which may overlap one
another and the base: parts of number runs that the rules drop as a whole, addresses with
letters beyond ASCII, telephone numbers without a plus.  A candidate is described by its format
(digits, check sum, separators, octets) and its context (the characters around it); boosted trees
learn from all candidates of the corpus which descriptions strict rules confirm, and
a threshold for each kind, calibrated on the half of the texts that the trees have not seen, selects
what is added.  Equal descriptions are counted in Spark first, so that the trees are grown from a
table bounded by the number of descriptions, and their sum is a Column again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
# Base patterns, written so that no start inside a run is tried in vain; possessive, as nothing follows.
# A run of digits that is too long for a card is no match, so only fitting runs are looked for.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser generators.
LOOSE = (
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)++(?<=\.\p{L}{2,63})"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
    ("card", r"(?<![0-9])[0-9]{12,19}+(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
FEATURES = ("kind", "generator", "digits", "luhn", "octets", "marks", "plus", "before", "after", "assigned")


# ---- linear work on arrays -----------------------------------------------------------------------

_RUN = 256  # elements, or code points, that are handled together
_STEPS = tuple(1 << k for k in range(30, -1, -1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before_each(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """Array of the fold, from 0 on, of the whole numbers that come before each; runs first, then their totals."""
    start = F.struct(_none("int").alias("seen"), F.lit(0).alias("at"))

    def scan(items: Column, value: Callable[[Column], Column]) -> Column:
        step = lambda a, x: F.struct(F.concat(a["seen"], F.array(a["at"])).alias("seen"), fold(a["at"], value(x)).alias("at"))
        return F.aggregate(items, start, step)

    def whole(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / _RUN).cast("int"), F.lit(0))
        runs = F.transform(F.sequence(F.lit(0), last), lambda k: scan(F.slice(v, k * _RUN + 1, F.lit(_RUN)), lambda x: x))
        add = lambda run, first: F.transform(run["seen"], lambda x: fold(first, x))
        return let(runs, lambda r: F.flatten(F.zip_with(r, scan(r, lambda x: x["at"])["seen"], add)))

    return let(values, whole)


def up_to(ordered: Column, x: Column) -> Column:
    """How many of the ascending whole numbers are at most x, by halving."""
    n = F.size(ordered)
    step = lambda at, s: F.when((at + s <= n) & (F.get(ordered, F.least(at + s, n) - 1) <= x), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), step)


def runs_of(text: Column) -> Column:
    """The text in runs of code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_RUN}}}"), F.lit(0))


def cut(runs: Column, low: Column, high: Column) -> Column:
    """Code points low to below high, without a walk from the start of the text."""
    low = F.greatest(low, F.lit(0))
    first, last = (F.floor(x / _RUN).cast("int") for x in (low, high - 1))
    part = F.array_join(F.slice(runs, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(high > low, F.substring(part, low - first * _RUN + 1, high - low)).otherwise("")


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (match, start) in code points, leftmost first, without overlaps."""

    def told(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.length(g))
        pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))

        def placed(p: Column) -> Column:
            sums = before_each(F.transform(p, lambda x: F.length(x["match"]) + x["gap"]), lambda a, x: a + x)
            return F.zip_with(p, sums, lambda x, at: F.struct(x["match"].alias("match"), (at + x["gap"]).alias("start")))

        return let(pairs, placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), told)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = lambda v, i: F.when(i % 2 == 1, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)
    values = F.transform(F.split(F.reverse(digits), ""), lambda x, i: doubled(x.try_cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def octets(match: Column) -> Column:
    small = lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.right(x, F.lit(3)).try_cast("int"), F.lit(999)) <= 255)
    parts = F.split(match, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, small)


def _fits(kind: str, match: Column) -> Column:
    n = F.length(digits_of(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(match)
    return (n >= 12) & (n <= 19) & luhn(digits_of(match)) if kind == "card" else (n >= 9) & (n <= 15)


def _worth(text: Column, pattern: str) -> Column:
    """Whether a text can match the pattern at all; cheap next to the pattern itself."""
    if "@" in pattern:
        return text.contains("@")
    if pattern.startswith(r"\+"):
        return text.contains("+")
    return text.rlike(r"[0-9]\." if pattern in (BASE["ip"], LOOSE[1][1]) else "[0-9]")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


_SPAN = "struct<start:int,kind:int,end:int>"


def base_spans(text: Column) -> Column:
    """(start, kind, end) of what the strict rules accept, by start and kind."""

    def part(number: int, kind: str) -> Column:
        found = F.filter(spans_of(text, BASE[kind]), lambda x: _fits(kind, x["match"]))
        span = lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), (x["start"] + F.length(x["match"])).alias("end"))
        return F.when(_worth(text, BASE[kind]), F.transform(found, span)).otherwise(_none(_SPAN))

    return F.sort_array(F.concat(*(part(number, kind) for number, kind in enumerate(KINDS))))


def _side(c: Column) -> Column:
    """Class of a neighbouring character: none or space, letter, digit, other."""
    return F.when((F.length(c) == 0) | c.rlike(r"\s"), 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)


def candidates(text: Column, runs: Column, base: Column) -> Column:
    """Array of candidates: start, end, FEATURES and ``hit``, all integers.

    ``hit`` is 1 for a base span, 2 for what overlaps one of its kind otherwise, else 0; base spans of a kind do not overlap,
    so the last one that starts before the candidate's end tells."""
    fields = ", ".join(f"{n}:int" for n in ("start", "end", *FEATURES, "hit"))

    def told(number: int, kind: str, x: Column, firsts: Column, own: Column) -> Column:
        m, start = x["match"], x["start"]
        digits, end = digits_of(m), start + F.length(m)
        front = cut(runs, start - 12, start)
        near = F.get(own, up_to(firsts, end - 1) - 1)
        hit = let(near, lambda b: F.when((b["start"] == start) & (b["end"] == end), 1).when(b["end"] > start, 2).otherwise(0))
        values = {
            "start": start,
            "end": end,
            "kind": F.lit(KINDS.index(kind)),
            "generator": F.lit(number),
            "digits": F.least(F.length(digits), F.lit(20)),
            "luhn": F.when(F.length(digits) > 11, luhn(digits).cast("int")).otherwise(0),
            "octets": octets(m).cast("int") if kind == "ip" else F.lit(0),
            "marks": F.least(F.length(m) - F.length(digits), F.lit(6)),
            "plus": m.startswith("+").cast("int"),
            "before": _side(F.right(front, F.when(start > 0, 1).otherwise(0))),
            "after": _side(cut(runs, end, end + 1)),
            "assigned": front.rlike(r"[=\"':]").cast("int"),
            "hit": hit,
        }
        return F.struct(*(v.cast("int").alias(k) for k, v in values.items()))

    def part(number: int, kind: str, pattern: str) -> Column:
        mine = F.filter(base, lambda b: b["kind"] == KINDS.index(kind))
        each = lambda own: let(F.transform(own, lambda b: b["start"]), lambda firsts: F.transform(spans_of(text, pattern), lambda x: told(number, kind, x, firsts, own)))
        found = let(mine, each)
        return F.when(_worth(text, pattern), found).otherwise(_none(f"struct<{fields}>"))

    return F.concat(*(part(number, kind, pattern) for number, (kind, pattern) in enumerate(LOOSE)))


# ---- boosted trees -----------------------------------------------------------------------------


@dataclass
class Tree:
    """value at a leaf; otherwise feature <= cut goes left."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    left: "Tree | None" = None
    right: "Tree | None" = None

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.of(x), self.right.of(x))

    def column(self, value: Callable[[str], Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(value(FEATURES[self.feature]) <= self.cut, self.left.column(value)).otherwise(self.right.column(value))


def grow(x: np.ndarray, slope: np.ndarray, weight: np.ndarray, depth: int, ridge: float = 1.0) -> Tree:
    total, mass = slope.sum(), weight.sum()
    best, choice = total**2 / (mass + ridge) + 1e-9, None
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            a, b = slope[low].sum(), weight[low].sum()
            gain = a**2 / (b + ridge) + (total - a) ** 2 / (mass - b + ridge)
            if gain > best:
                best, choice = gain, (f, int(cut), low)
    if choice is None:
        return Tree(float(total / (mass + ridge)))
    f, cut, low = choice
    return Tree(0.0, f, cut, grow(x[low], slope[low], weight[low], depth - 1, ridge), grow(x[~low], slope[~low], weight[~low], depth - 1, ridge))


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4) -> list[Tree]:
    """Trees whose sum is the log odds of ``yes`` against ``no`` for each row of x."""
    out, odds = [], np.zeros(len(x))
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-odds))
        tree = grow(x, yes - (yes + no) * p, (yes + no) * p * (1 - p), depth)
        odds += rate * tree.of(x)
        out.append(tree)
    return out


@dataclass
class Model:
    trees: list[Tree]
    rate: float
    least: list[float]  # log odds from which a candidate of each kind is added; inf: never

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum((t.of(x) for t in self.trees), np.zeros(len(x)))

    def accepts(self, candidate: Column) -> Column:
        value = lambda name: candidate[name]
        odds = sum((t.column(value) for t in self.trees), F.lit(0.0)) * self.rate
        bars = [F.when((candidate["kind"] == k) & (odds >= bar), True) for k, bar in enumerate(self.least) if math.isfinite(bar)]
        return F.coalesce(*bars, F.lit(False))


def calibrated(odds: np.ndarray, yes: np.ndarray, no: np.ndarray, precision: float) -> float:
    """The lowest bar above which the share of ``yes`` is ``precision`` or more at every value."""
    bar = math.inf
    for value in sorted(set(odds.tolist()), reverse=True):
        at = odds == value
        if yes[at].sum() < precision * (yes[at].sum() + no[at].sum()):
            break
        bar = value
    return bar


def fit(cells: Sequence[tuple], precision: float, rate: float = 0.4) -> Model:
    """cells: (*FEATURES, half, confirmed, others)."""
    data = np.array(cells, dtype=np.float64).reshape(-1, len(FEATURES) + 3)
    x, half, yes, no = data[:, : len(FEATURES)], data[:, -3], data[:, -2], data[:, -1]
    seen = half == 0
    model = Model(boost(x[seen], yes[seen], no[seen], rate=rate), rate, [])
    odds = np.round(model.odds(x), 9)
    for kind in range(len(KINDS)):
        mine = ~seen & (x[:, 0] == kind)
        bar = calibrated(odds[mine], yes[mine], no[mine], precision)
        model.least.append(max(bar - 1e-6, math.log(precision / (1 - precision))) if math.isfinite(bar) else math.inf)
    return model


# ---- the whole -------------------------------------------------------------------------------


def find(docs: DataFrame, text: str = "text", carried: Sequence[str] = ("doc_id",), precision: float = 0.9) -> DataFrame:
    """One row per row of ``docs``: the ``carried`` columns, ``base`` and ``spans``.

    Both are arrays of (start, kind, end) in code points, ends exclusive, kind as a place in
    KINDS, by start and kind; ``spans`` holds the base ones and those the trees add, which do not
    overlap a base span of their kind.  A null text counts as empty.  Texts, descriptions and counts cover all
    rows; where no candidate is confirmed, nothing is added.  Carried columns may have any name but ``base`` and
    ``spans``; an empty table gives no rows.
    """
    return _found(docs, text, carried, precision).withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carried)})


def _found(docs: DataFrame, text: str, carried: Sequence[str], precision: float) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carried)), t.alias("t"))
    whole = let(base_spans(F.col("t")), lambda b: F.struct(b.alias("base"), let(runs_of(F.col("t")), lambda r: candidates(F.col("t"), r, b)).alias("cands")))
    names = [c for c in kept.columns if c != "t"]
    both = written(kept.select(*names, whole.alias("both"), (F.xxhash64("t") % 2 == 0).cast("int").alias("half")))
    found = both.select(*names, F.col("both.base").alias("base"), F.col("both.cands").alias("cands"), "half")
    # What overlaps a base span is neither confirmed nor refuted.
    one = found.select("half", F.explode("cands").alias("c")).filter(F.col("c.hit") < 2)
    cells = one.groupBy(*(F.col(f"c.{n}").alias(n) for n in FEATURES), "half").agg(F.sum("c.hit").alias("yes"), F.sum(1 - F.col("c.hit")).alias("no"))
    model = fit([tuple(r) for r in cells.orderBy(*FEATURES, "half").collect()], precision)
    added = F.filter("cands", lambda x: (x["hit"] == 0) & model.accepts(x))
    added = F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    added = F.when(F.size("cands") > 0, added).otherwise(_none(_SPAN))
    every = let(F.sort_array(F.concat("base", added)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1) != x)))
    return found.withColumn("spans", every).select(*(f"_c{i}" for i in range(len(carried))), "base", "spans")


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or stretch of overlapping spans, replaced by its kind's name in angle brackets."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    ends = lambda s: F.transform(s, lambda x: x["end"])

    def done(s: Column) -> Column:
        done_to = before_each(ends(s), F.greatest)
        piece = lambda r: lambda x, at: F.when(x["start"] >= at, F.concat(cut(r, at, x["start"]), F.get(names, x["kind"]))).otherwise("")
        rest = lambda r: F.array(cut(r, F.array_max(ends(s)), F.length(text)))
        return let(runs_of(text), lambda r: F.array_join(F.concat(F.zip_with(s, done_to, piece(r)), rest(r)), ""))

    return F.when(F.size(spans) > 0, let(spans, done)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", precision: float = 0.9) -> DataFrame:
    """``docs`` with its spans replaced in the text; null texts stay null, all columns and rows stay."""
    names = docs.columns
    found = _found(docs, text, names, precision)
    place = f"_c{names.index(text)}"
    found = found.withColumn(place, redacted(F.col(place), F.col("spans")))
    return found.select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names)))
