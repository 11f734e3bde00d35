"""Personal data by boosted trees over proposed spans; columns and SQL functions only.

For each kind a strict pattern gives base spans, found leftmost and without overlap; a match
that fails its check (address parts, check digit, number of digits) is dropped. Those stay in
any case. Looser patterns propose more spans, which may overlap: parts of dropped matches,
numbers without a plus, written-out addresses. Only valid ones are added: a card's check digit, a
number's range or length, an address that ends in a top-level domain. Each span has a few small
whole-number features of its format and context, so the corpus comes down to counts per feature
combination (bounded by the product of their ranges), and the trees are boosted on those counts of
the valid spans. Positive are, besides base spans, cards and addresses (their check is
evidence enough) and others with a word before them that names their kind. One half of the
documents fits the trees; each score, so each group of like combinations, is then judged on its own
by the other half (by the first if that has none), and taken if ``precision`` of its spans are positive.
A proposed span with such a score is added if it overlaps no base span, and no better span of its kind.

Offsets are code points, ends exclusive. No pattern crosses a line break, and none needs more
than linear time. A null text is empty and has no spans; rows that repeat give repeated
results; if there is nothing to learn from nothing is added. Other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
ROUNDS, LEAVES_DEPTH, RATE = 20, 3, 0.3
EDGE = 2e-9  # scores this close are one
SURE = ("email", "card")  # kinds whose check hardly passes by chance
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]++"
# A run before an @ starts where the run of its characters does, or where the last match
# ended; saying so keeps long runs without @ linear. Repeated groups are possessive, as Java
# goes one call deeper for each repetition of others; nothing after them could need a character back.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\(at\)|\[at\])\x20?{_LABEL}(?:(?:\x20\.\x20|\x20?\.(?:\x20(?=[a-z]))?|\x20?(?:\(dot\)|\[dot\])\x20?){_LABEL})++",
    "ip": r"(?<![0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[\x20-]){3}[0-9]{4}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
# Every number span lies in one of these: the shortest, 1.1.1.1, has seven characters.
NUMBERS = r"\+?[0-9][0-9\x20().-]{6,}"
_TRIGGER = {
    "email": r"(?i)(mail|contact|write|address)",
    "ip": r"(?i)(\bip\b|host|server|address|login)",
    "card": r"(?i)(card|visa|credit|debit|pay)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|sms)",
}
FEATURES = ("kind", "digits", "groups", "style", "before_class", "after_class", "trigger")
_SPAN = "struct<at:int,s:string,before:string,after:string>"


def located(text: Column, pattern: str) -> Column:
    """Matches with their place, the 24 characters before and the one after."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cuts = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("s"), cuts.alias("cut"), F.slice(cuts, 2, 2**31 - 1).alias("rest"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(done: Column, row: Column) -> Column:
        at = done["at"] + F.length(row["cut"])
        span = F.struct(at.alias("at"), row["s"].alias("s"), F.substring(row["cut"], -24, 24).alias("before"),
                        F.substring(row["rest"], 1, 1).alias("after"))
        return F.when(row["s"].isNull(), done).otherwise(
            F.struct((at + F.length(row["s"])).alias("at"), F.concat(done["out"], F.array(span)).alias("out")))

    return F.aggregate(rows, start, step, lambda done: done["out"])


def _inside(windows: Column, pattern: str) -> Column:
    """Matches in each window, placed in the text."""
    def of(w: Column) -> Column:
        def placed(m: Column) -> Column:
            before = F.concat(w["before"], F.substring(w["s"], F.lit(1), m["at"]))
            after = F.when(m["after"] == "", w["after"]).otherwise(m["after"])
            return F.struct((w["at"] + m["at"]).alias("at"), m["s"].alias("s"),
                            F.substring(before, -24, 24).alias("before"), after.alias("after"))
        return F.transform(located(w["s"], pattern), placed)
    return F.flatten(F.transform(windows, of))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _check_digit(s: Column) -> Column:
    """Whether the digits pass the Luhn check; only for 13 to 19 digits."""
    digits = F.reverse(_digits(s))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    count = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.lit(0), add)
    return F.when(count.between(13, 19), total % 10 == 0).otherwise(False)


def passes(kind: str, s: Column) -> Column:
    """The check a match of the strict pattern must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$")
    if kind == "card":
        return _check_digit(s)
    return F.length(_digits(s)).between(9, 15)


def _class_of(char: Column) -> Column:
    return (F.when(char == "", 0).when(char.rlike(r"^\s"), 1).when(char.rlike(r"^\p{L}"), 2)
            .when(char.rlike("^[0-9]"), 3).otherwise(4))


def _features(kind: str, span: Column) -> Column:
    s = span["s"]
    marks = F.regexp_replace(s, r"[0-9+]", "")
    if kind == "email":
        marks = F.lit("")  # an @ would only repeat what base spans are
        valid = s.rlike(r"\.\x20?[A-Za-z]{2,}$|\)[\x20]?[A-Za-z]{2,}$|\][\x20]?[A-Za-z]{2,}$")
    else:
        valid = F.length(_digits(s)).between(9, 15) if kind == "phone" else passes(kind, s)
    style = (F.when(marks == "", 0).when(marks.rlike(r"^\.+$"), 1).when(marks.rlike("^-+$"), 2)
             .when(marks.rlike(r"^\x20+$"), 3).when(marks.contains("("), 4).otherwise(5))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), span["at"].alias("at"), (span["at"] + F.length(s)).alias("end"),
        F.least(F.length(_digits(s)), F.lit(20)).alias("digits"), valid.cast("int").alias("valid"),
        F.least(F.size(F.split(s, r"[^0-9+]+")) - 1, F.lit(7)).alias("groups"), style.alias("style"),
        _class_of(F.substring(span["before"], -1, 1)).alias("before_class"), _class_of(span["after"]).alias("after_class"),
        span["before"].rlike(_TRIGGER[kind]).cast("int").alias("trigger"))


def _passing(kind: str, wanted: bool):
    return lambda x: passes(kind, x["s"]) if wanted else ~passes(kind, x["s"])


def _featured(kind: str):
    return lambda x: _features(kind, x)


def _of_kind(kind: int):
    return lambda x: x["kind"] == kind


def proposed(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with two more columns, __base and __loose: spans with their features."""
    own = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    numbers = F.when(own.rlike("[0-9]"), located(own, NUMBERS)).otherwise(none)
    strict = {"email": F.when(own.contains("@"), located(own, BASE["email"])).otherwise(none)}
    loose = {"email": F.when(own.rlike(r"[(\[]at[)\]]"), located(own, LOOSE["email"])).otherwise(none)}
    rows = documents.withColumn("__numbers", numbers)
    for kind in KINDS[1:]:
        strict[kind] = _inside(F.col("__numbers"), BASE[kind])
        loose[kind] = _inside(F.col("__numbers"), LOOSE[kind])
    rows = rows.select("*", *[strict[k].alias(f"__strict_{k}") for k in KINDS], *[loose[k].alias(f"__more_{k}") for k in KINDS])
    kept, more = [], []
    for kind in KINDS:
        kept.append(F.transform(F.filter(f"__strict_{kind}", _passing(kind, True)), _featured(kind)))
        more.append(F.transform(F.concat(F.filter(f"__strict_{kind}", _passing(kind, False)), F.col(f"__more_{kind}")),
                                _featured(kind)))
    hidden = ["__numbers", *[f"__strict_{k}" for k in KINDS], *[f"__more_{k}" for k in KINDS]]
    rows = rows.select("*", F.concat(*kept).alias("__base"), F.array_distinct(F.concat(*more)).alias("__any")).drop(*hidden)

    def apart(x: Column) -> Column:
        return ~F.exists("__base", lambda b: (b["kind"] == x["kind"]) & (b["at"] < x["end"]) & (x["at"] < b["end"]))

    return rows.withColumn("__loose", F.filter("__any", apart)).drop("__any")


def boost(x: np.ndarray, positive: np.ndarray, count: np.ndarray, rounds: int = ROUNDS, depth: int = LEAVES_DEPTH,
          rate: float = RATE) -> tuple[float, list]:
    """Logistic boosting of small trees on counted feature combinations: (first score, trees).

    A tree is a number or (feature, limit, tree up to the limit, tree above).
    """
    base = math.log((positive.sum() + 1) / (count.sum() - positive.sum() + 1))
    score, trees = np.full(len(x), base), []

    def grow(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray, left: int):
        g, h = gradient[rows].sum(), weight[rows].sum()
        best, gain = None, 1e-6
        for f in range(x.shape[1]) if left else ():
            for limit in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= limit
                gl, hl = gradient[rows][low].sum(), weight[rows][low].sum()
                won = gl**2 / (hl + 1) + (g - gl)**2 / (h - hl + 1) - g**2 / (h + 1)
                if won > gain:
                    best, gain = (f, int(limit), low), won
        if best is None:
            value = rate * g / (h + 1)
            score[rows] += value
            return float(value)
        f, limit, low = best
        return f, limit, grow(rows[low], gradient, weight, left - 1), grow(rows[~low], gradient, weight, left - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(x)), positive - count * p, count * p * (1 - p), depth))
    return base, trees


def value_of(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _as_column(tree, span: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(span[FEATURES[tree[0]]] <= tree[1], _as_column(tree[2], span)).otherwise(_as_column(tree[3], span))


class Trees:
    """Boosted trees and the ranges of scores that are taken of each kind."""

    def __init__(self, counts: list, precision: float = PRECISION):
        """``counts``: rows of FEATURES, fit (bool), positive, n."""
        x = np.array([[r[f] for f in FEATURES] for r in counts], np.int64).reshape(-1, len(FEATURES))
        positive, n = (np.array([r[c] for r in counts], float) for c in ("positive", "n"))
        fit = np.array([r["fit"] for r in counts], bool)
        self.ranges: list[list[tuple[float, float]]] = [[] for _ in KINDS]
        self.base, self.trees = 0.0, []
        if not fit.any():
            return
        self.base, self.trees = boost(x[fit], positive[fit], n[fit])
        score = np.array([self.base + sum(value_of(t, row) for t in self.trees) for row in x])
        for kind in range(len(KINDS)):
            rows = np.flatnonzero(x[:, 0] == kind)
            levels, at = np.unique(score[rows].round(9), return_inverse=True)
            good, among = ([np.bincount(at, c[rows] * part[rows], len(levels)) for part in (~fit, fit)] for c in (positive, n))
            checked = among[0] > 0
            taken = np.where(checked, good[0], good[1]) >= precision * np.where(checked, among[0], among[1])
            for level, last, own in zip(levels, [False, *taken[:-1]], taken):
                if own and last:  # neighbouring levels make one range
                    self.ranges[kind][-1] = (self.ranges[kind][-1][0], level + EDGE)
                elif own:
                    self.ranges[kind].append((level - EDGE, level + EDGE))

    def score(self, span: Column) -> Column:
        return reduce(lambda a, b: a + b, [_as_column(t, span) for t in self.trees], F.lit(self.base))

    def wanted(self, span: Column) -> Column:
        taken = F.lit(False)
        for kind, ranges in enumerate(self.ranges):
            for low, high in ranges:
                taken = taken | ((span["kind"] == kind) & span["score"].between(float(low), float(high)))
        return (span["valid"] == 1) & taken


def train(rows: DataFrame, precision: float = PRECISION) -> Trees:
    """Trees from all valid spans of the rows of ``proposed``; the driver gets counts per combination."""
    def evidence(s: Column) -> Column:
        return (s["kind"].isin([KINDS.index(k) for k in SURE]) | (s["trigger"] == 1)).cast("int")

    fit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0).alias("fit")
    spans = rows.select(F.coalesce(fit, F.lit(True)).alias("fit"), F.explode(F.concat(
        F.transform("__base", lambda s: F.struct(F.lit(1).alias("y"), s.alias("s"))),
        F.transform("__loose", lambda s: F.struct(evidence(s).alias("y"), s.alias("s"))))).alias("x"))
    counts = spans.where("x.s.valid = 1").groupBy("fit", *[F.col(f"x.s.{f}").alias(f) for f in FEATURES]).agg(
        F.sum("x.y").alias("positive"), F.count(F.lit(1)).alias("n"))
    return Trees(sorted(counts.collect()), precision)


def found(documents: DataFrame, trees: Trees | None = None) -> DataFrame:
    """The rows with ``__base`` and ``__spans``: base spans, and all spans, as arrays of
    (kind, at, end) by kind, then place."""
    rows = proposed(documents)
    trees = train(rows) if trees is None else trees

    def plain(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["end"].alias("end"))

    scored = F.transform("__loose", lambda s: F.struct(
        trees.score(s).alias("score"), s["valid"].alias("valid"), s["kind"].alias("kind"), s["at"].alias("at"), s["end"].alias("end")))
    def free(x: Column) -> Column:
        return trees.wanted(x) & ~F.exists("__base", lambda b: (b["at"] < x["end"]) & (x["at"] < b["end"]))

    rows = rows.withColumn("__scored", F.filter(scored, free)).drop("__loose")

    def unbeaten(x: Column) -> Column:
        def beats(y: Column) -> Column:
            better = (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (
                (y["end"] - y["at"] > x["end"] - x["at"]) | ((y["end"] - y["at"] == x["end"] - x["at"]) & (y["at"] < x["at"]))))
            return (y["kind"] == x["kind"]) & (y["at"] < x["end"]) & (x["at"] < y["end"]) & better
        return ~F.exists("__scored", beats)

    rows = rows.withColumn("__base", F.array_sort(F.transform("__base", plain)))
    spans = F.array_sort(F.array_distinct(F.concat("__base", F.transform(F.filter("__scored", unbeaten), plain))))
    return rows.withColumn("__spans", spans).drop("__scored")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["at"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, base spans per kind, digest of the base spans, all spans, number of added spans."""
    rows = found(documents.select("doc_id", "text"))
    counts = [F.size(F.filter("__base", _of_kind(k))).cast("long").alias(f"n_{kind}")
              for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("__base")), 256).alias("base_sha256"),
                       listed(F.col("__spans")).alias("spans"),
                       (F.size("__spans") - F.size("__base")).cast("long").alias("n_added"))


def redact(documents: DataFrame, trees: Trees | None = None) -> DataFrame:
    """The documents with every span replaced by [KIND] and n_chars set anew; spans that
    overlap become one mark, named after the first. Texts without spans, and null, stay."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = found(documents, trees)
    by_place = F.array_sort(F.transform("__spans", lambda s: F.struct(
        s["at"].alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), done["at"] + 1, s["at"] - done["at"])
        return F.when(s["at"] < done["at"], F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["text"].alias("text"))
                      ).otherwise(F.struct(s["end"].alias("at"), F.concat(
                          done["text"], between, F.get(names, s["kind"])).alias("text")))

    def rest(done: Column) -> Column:
        return F.concat(done["text"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))

    text = F.when(F.size("__spans") == 0, F.col("text")).otherwise(F.aggregate(by_place, start, step, rest))
    out = rows.withColumn("text", text)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"]))
    return out.select(documents.columns)
