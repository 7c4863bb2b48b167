"""Quality rules: base statistics of every text, and a learned decision list over them. DataFrame functions only.

The list is learned by sequential covering: a rule is a conjunction of thresholds, grown on one part of the labelled statistics by the gain
of each further condition, cut back from its end on the other part, and kept if it is still precise there; what it covers is removed
and the next rule is learned. The result is an ordered list of conditions, rendered as one Spark expression that can be read.

Words are runs of anything but ASCII white space. Windows of eight words are compared by 64-bit hashes of word hashes within a text.

Defined results: a null or empty text has no words and fails the base rules. Without labels of both kinds the list is empty and keeps
whatever passes the base rules. Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.llm import sampling

WINDOW = 8
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the labelled statistics a list is learned from: at most so many documents of each label."""

    per_class: int = 3000
    thresholds: int = 64  # tried for each statistic
    conditions: int = 4  # of a rule
    rules: int = 12
    precision: float = 0.9  # that a rule must have on the part it was not grown on
    least: int = 5  # bad documents that a rule must cover there


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, at least or at most, threshold) together mean: low quality."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, value in self.conditions:
            out = out & (F.col(name) >= value if sign == ">=" else F.col(name) <= value)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {v:g}" for n, s, v in self.conditions)


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and the rates that rules are learned from, for every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    flat = F.translate(text, _SPACES[1:], " " * 5)
    d = docs.select(
        "doc_id",
        F.transform(F.array_remove(F.split(flat, " "), ""), lambda w: F.xxhash64(w)).alias("words"),
        lines.alias("lines"),
        _without(text, _SPACES).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, _SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - _without(text, _CAPITALS)).cast("long").alias("n_capitals"),
        (F.length(text) - _without(text, "!?")).cast("long").alias("n_marks"),
    )
    kept = ["doc_id", "word_chars", "n_symbols", "n_capitals", "n_marks"]
    d = d.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    kept += ["n_words", "n_dup_lines"]
    # only texts with a repeated window sort their windows
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select(*kept, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs).otherwise(none).alias("pairs"))

    def repeated(p: Column, i: Column) -> Column:
        same = [F.get("pairs", j).getField("h").eqNullSafe(p.getField("h")) for j in (i - 1, i + 1)]
        return same[0] | same[1]

    found = F.filter("pairs", repeated)
    d = d.select(*kept, F.sort_array(F.transform(found, lambda p: p.getField("i"))).alias("at"))
    step = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW))))
    d = d.select(*kept, F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x).alias("n_repeat_words"))
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return d.withColumns({
        "symbols_per_word": F.col("n_symbols") / per_word,
        "capitals_per_word": F.col("n_capitals") / per_word,
        "marks_per_word": F.col("n_marks") / per_word,
        "chars_per_word": F.col("word_chars") / per_word,
        "dup_lines_per_word": F.col("n_dup_lines") / per_word,
        "repeat_share": F.col("n_repeat_words") / per_word,
    })


FEATURES = ("symbols_per_word", "capitals_per_word", "marks_per_word", "chars_per_word", "dup_lines_per_word", "repeat_share")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn(x: np.ndarray, bad: np.ndarray, ids: list, s: Settings = Settings()) -> list[Rule]:
    """Rules for low quality from rows of ``FEATURES``; ``ids`` decide which third a rule is pruned on."""
    prune = np.array([crc32(f"prune {i}".encode()) % 3 == 0 for i in ids], dtype=bool)
    rules: list[Rule] = []
    live = np.ones(len(bad), dtype=bool)
    while len(rules) < s.rules:
        grow, test = live & ~prune, live & prune
        conditions = _grow(x[grow], bad[grow], s)
        conditions = _cut_back(conditions, x[test], bad[test])
        if not conditions:
            break
        hit = _covers(conditions, x)
        right, all_hit = int((hit & test & bad).sum()), int((hit & test).sum())
        if right < s.least or right < s.precision * all_hit:
            break
        rules.append(Rule(tuple((FEATURES[f], sign, value) for f, sign, value in conditions)))
        live &= ~hit
    return rules


def _covers(conditions: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for f, sign, value in conditions:
        hit &= x[:, f] >= value if sign == ">=" else x[:, f] <= value
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, s: Settings) -> list[tuple[int, str, float]]:
    """Conditions of the best gain, one after the other, until only bad rows are covered."""
    conditions: list[tuple[int, str, float]] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(conditions) < s.conditions and bad[inside].any() and not bad[inside].all():
        now = np.log2(bad[inside].mean())
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            values = np.unique(np.quantile(x[inside, f], np.linspace(0, 1, s.thresholds)))
            # a threshold lies half-way between two values that occur, so that rows near it fall on the side of their like
            own = np.unique(x[inside, f])
            place = np.searchsorted(own, values)
            middles = np.where(place > 0, (own[np.maximum(place - 1, 0)] + own[np.minimum(place, len(own) - 1)]) / 2, values)
            for sign, covered in (
                (">=", x[inside, f][:, None] >= middles[None, :]), ("<=", x[inside, f][:, None] <= middles[None, :])
            ):
                p = covered[bad[inside]].sum(0)
                n = covered.sum(0)
                gains = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - now), 0)
                k = int(gains.argmax())
                if gains[k] > gain:
                    best, gain = (f, sign, float(middles[k])), gains[k]
        if best is None:
            break
        conditions.append(best)
        inside &= _covers([best], x)
    return conditions


def _cut_back(conditions: list[tuple[int, str, float]], x: np.ndarray, bad: np.ndarray) -> list[tuple[int, str, float]]:
    """The beginning of the rule that is worth most on rows it was not grown on."""

    def worth(part: list[tuple[int, str, float]]) -> float:
        hit = _covers(part, x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    parts = [conditions[:k] for k in range(1, len(conditions) + 1)]
    return max(parts, key=lambda part: (worth(part), -len(part)), default=[])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings()) -> list[Rule]:
    """Learn from the statistics of a bounded sample of labelled documents; label 0 is low quality."""
    chosen = sampling.sample_ids(docs, labels, label, [0, 1], s.per_class)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # filtered after collecting this bounded sample: a filter would be pushed below, and with it the computation repeated
    rows = statistics(picked).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", *FEATURES, base_failed().alias("failed"))
    found = sorted(r for r in rows.collect() if not r.failed)
    if not found:
        return []
    x = np.array([r[2:-1] for r in found], dtype=float)
    return learn(x, np.array([r.label == 0 for r in found]), [r.doc_id for r in found], s)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The base counts of every row, ``base_failed``, ``rule`` (text of the first rule that holds, or null) and ``kept``."""
    d = statistics(docs).withColumn("base_failed", base_failed())
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.column(), F.lit(str(rule))).otherwise(verdict)
    d = d.withColumn("rule", verdict)
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
