"""Similarity of strings by their longest common subsequence, as column expressions.

ratio(a, b) is 100 * 2 * LCS / (|a| + |b|); partial_ratio is the highest ratio of the shorter
string with a window of its length, or a shorter prefix or suffix, of the longer one. Lengths
count code points. A row of the table of subsequences is the running maximum of what a match or
the row above gives, so each row is one pass over the characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _lcs_chars(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two arrays of characters."""
    first = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(above: Column, c: Column) -> Column:
        start = F.array(F.lit(0))

        def cell(done: Column, x: Column) -> Column:
            j = F.size(done)
            best = F.greatest(above[j], F.element_at(done, -1), F.when(x == c, above[j - 1] + 1).otherwise(F.lit(0)))
            return F.array_append(done, best)

        return F.aggregate(b, start, cell)

    return F.element_at(F.aggregate(a, first, row), -1)


def lcs(a: Column, b: Column) -> Column:
    return _let(_chars(b), lambda y: _lcs_chars(_chars(a), y))


def _ratio_chars(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(100.0)).otherwise(200.0 * _lcs_chars(a, b) / n)


def ratio(a: Column, b: Column) -> Column:
    return _let(_chars(a), lambda x: _let(_chars(b), lambda y: _ratio_chars(x, y)))


def _best_window(s: Column, long: Column) -> Column:
    """The highest ratio of s with a window of long; s is not empty."""
    m, n = F.size(s), F.size(long)
    starts = F.sequence(F.lit(2) - m, n)
    window = lambda k: F.slice(long, F.greatest(k, F.lit(1)), F.least(k + m - 1, n) - F.greatest(k, F.lit(1)) + 1)
    return F.array_max(F.transform(starts, lambda k: _ratio_chars(s, window(k))))


def partial_ratio(a: Column, b: Column) -> Column:
    def of(x: Column, y: Column) -> Column:
        m, n = F.size(x), F.size(y)
        one = _best_window(x, y)
        return (
            F.when((m == 0) & (n == 0), F.lit(100.0)).when((m == 0) | (n == 0), F.lit(0.0)).when(m < n, one).when(m > n, _best_window(y, x)).otherwise(F.greatest(one, _best_window(y, x)))
        )

    return _let(_chars(a), lambda x: _let(_chars(b), lambda y: of(x, y)))
