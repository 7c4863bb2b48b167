"""Fuzzy token matching."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity_ratio(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio of two strings, ignoring case. Spark has no such built-in."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)]
        )

    return ratio(left, right)


def _fuzzy_best(words: list[str], threshold: float):
    """Per row: the best ratio >= threshold of each query word over the row's tokens.

    A token's scores are computed once per Arrow batch, however many rows repeat it.
    """

    @F.pandas_udf("array<double>")
    def best(token_lists: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}

        def scores(token: str) -> list[float]:
            if token not in known:
                ratios = [difflib.SequenceMatcher(None, w, token).ratio() for w in words]
                known[token] = [r if r >= threshold else 0.0 for r in ratios]
            return known[token]

        def row(tokens) -> list[float]:
            columns = [scores(t) for t in tokens]
            return [max(c) for c in zip(*columns)] if columns else [0.0] * len(words)

        return token_lists.map(row)

    return best.asNondeterministic()


def _contained(word: str):
    return lambda token: token.contains(word) | F.lit(word).contains(token)


def best_matches(tokens: Column, words: list[str], threshold: float = 0.8) -> Column:
    """one score per query word: 1 for containment either way, else the best fuzzy ratio.

    Containment is decided in the JVM. Only tokens long enough to reach the threshold are handed
    to the fuzzy scorer: a ratio is at most 2*min/(m+n), which the lengths alone decide.
    """
    words = [w.lower() for w in words]

    def reachable(token: Column) -> Column:
        test = F.lit(False)
        for word in words:
            n = len(word)
            size = F.length(token)
            test = test | (F.least(size, F.lit(n)) * 2.0 >= (size + n) * threshold)
        return test

    fuzzy = _fuzzy_best(words, threshold)(F.filter(tokens, reachable))
    scores = []
    for i, word in enumerate(words):
        inside = F.exists(tokens, _contained(word))
        scores.append(F.when(inside, F.lit(1.0)).otherwise(F.get(fuzzy, F.lit(i))))
    return F.array(*scores)
