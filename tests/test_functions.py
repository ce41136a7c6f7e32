"""Similarity and language."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import language, similarity

RATIO = [("cpall", "call", 88.888889), ("ptt", "ptr", 66.666667), ("kbnk", "kbank", 88.888889), ("cp", "cpall", 57.142857), ("jasmin", "jas", 66.666667), ("abcd", "bcda", 75.0), ("", "", 100.0), ("", "a", 0.0)]
PARTIAL = [
    ("cpall", "call", 85.714286),
    ("ptt", "ptr", 80.0),
    ("kbnk", "kbank", 75.0),
    ("abcd", "bcda", 85.714286),
    ("bank", "kasikornbank public company limited", 100.0),
    ("energy", "ptt public company limited", 33.333333),
    ("ธนาคาร", "ธนาคารกสิกรไทย จำกัด (มหาชน)", 100.0),
    ("", "a", 0.0),
]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        row = _step(row, c, b)
    return row[-1]


def _step(above, c, b):
    out = [0]
    for j, x in enumerate(b):
        out.append(above[j] + 1 if x == c else max(above[j + 1], out[-1]))
    return out


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    one = lambda s, t: max(ratio(s, t[max(k, 0) : min(k + len(s), len(t))]) for k in range(1 - len(s), len(t)))
    return one(a, b) if len(a) < len(b) else one(b, a) if len(a) > len(b) else max(one(a, b), one(b, a))


def both(spark, pairs):
    df = spark.createDataFrame([(*p[:2], k) for k, p in enumerate(pairs)], "a string, b string, k int")
    df = df.select("k", similarity.ratio(F.col("a"), F.col("b")), similarity.partial_ratio(F.col("a"), F.col("b")))
    return [tuple(r)[1:] for r in df.orderBy("k").collect()]


def test_vectors(spark):
    assert [r for r, _ in both(spark, RATIO)] == pytest.approx([w for *_, w in RATIO], abs=1e-6)
    assert [p for _, p in both(spark, PARTIAL)] == pytest.approx([w for *_, w in PARTIAL], abs=1e-6)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("abก ", max_size=6), st.text("abก ", max_size=9)), min_size=20, max_size=20))
def test_against_plain_python(spark, pairs):
    for (a, b), (r, p) in zip(pairs, both(spark, pairs), strict=True):
        assert r == pytest.approx(ratio(a, b)) and p == pytest.approx(partial(a, b))
        assert 0 <= r <= 100 and 0 <= p <= 100


def test_language(spark):
    assert [language.detect(t) for t in ("bank", "ธนาคาร", "a ก", "")] == ["en", "th", "th", "en"]
    df = spark.createDataFrame([("bank",), ("a ก",)], "t string")
    assert [r[0] for r in df.select(language.detected(df.t)).collect()] == ["en", "th"]
