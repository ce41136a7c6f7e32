"""Quality by hierarchical empirical Bayes: a document classifier with host and path posteriors.

The classifier, a logistic regression for each target (low quality, toxic), is fitted in numpy on
a bounded sample of labelled documents: word and word-start lexicons come from one half of it,
weights from the other. It gives each document its evidence (log odds). Evidence is summed by
host and by path with ordinary grouped aggregation over all documents; the spread between sites,
estimated by moments around the rate above them, sets how strongly a site is shrunk: a host towards
the corpus, a path towards its host. A document's posterior joins its own evidence with the rate of its path, taken
without itself, so that sparse sites say nothing and the sum of evidence says what it should.

Defined results: a null text is empty; a null host or path is a site of its own; rows that are
equal each count and get equal results; with fewer than 20 labels of either kind a target's evidence
is -5 (a chance of 0.0067) for all, so nothing is rejected; an empty table gives an empty result;
texts count whole at any length; only the columns named are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored, text_of
from quarry.llm.quality_rules import FEATURES, feature, statistics

TARGETS = ("low", "toxic")
#: Labelled documents that are read at most, words kept for each target at most, sites that are broadcast at most.
MAX_LABELLED, LEXICON, HOT = 6_000, 3_000, 1_000
PREFIX = 5
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> set[str]:
    """Distinct words in lower case and, with a mark, their starts."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:PREFIX] + "*" for w in words}


def lexicon(found: list[set[str]], positive: np.ndarray) -> dict[str, float]:
    """Log odds of the tokens that tell most, by a chi-square test; at most ``LEXICON``."""
    n1, n0 = int(positive.sum()), int((~positive).sum())
    if n1 < 10 or n0 < 10:
        return {}
    with_, without = Counter(), Counter()
    for f, p in zip(found, positive, strict=True):
        (with_ if p else without).update(f)
    scored = []
    for t, a in with_.items():
        b = without[t]
        if a < 4:
            continue
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        expected = (a + b) * n1 / (n1 + n0)
        if odds > np.log(4) and (a - expected) ** 2 / expected > 15:
            scored.append((odds * np.sqrt(a), t, odds))
    return {t: float(min(o, 8.0)) for _, t, o in sorted(scored, reverse=True)[:LEXICON]}


def lexical(found: Iterable[str], lex: dict[str, float]) -> tuple[float, float]:
    """The highest log odds of a token, and the logarithm of how many there are."""
    hits = [lex[t] for t in found if t in lex]
    return (max(hits), float(np.log1p(len(hits)))) if hits else (0.0, 0.0)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scaled(stats: np.ndarray) -> np.ndarray:
    """Shares and lengths on a logarithmic scale."""
    return np.log1p(np.column_stack([stats[:, 0], stats[:, 1], 100 * stats[:, 2:]]))


class Classifier:
    """Lexicons and weights for both targets."""

    def __init__(self, texts: list[str], stats: np.ndarray, labels: dict[str, np.ndarray]) -> None:
        found = [tokens(t) for t in texts]
        half = np.arange(len(texts)) % 2 == 0
        x = _scaled(stats) if len(texts) else np.empty((0, len(FEATURES)))
        self.lexicons, self.weights, self.prior = {}, {}, {}
        for t in TARGETS:
            y = labels[t]
            if y.sum() < 20 or (~y).sum() < 20:
                self.lexicons[t], self.weights[t], self.prior[t] = {}, None, 0.0
                continue
            lex = lexicon([f for f, h in zip(found, half, strict=True) if h], y[half])
            words = np.array([lexical(f, lex) for f in found])
            both = np.column_stack([x, words])
            # Statistics may learn from all rows, words only from those that made no lexicon.
            self.weights[t] = fit(both[~half], y[~half].astype(float))
            self.lexicons[t] = lex
            self.prior[t] = float(np.log(y[~half].mean() / (1 - y[~half].mean())))

    def evidence(self, texts: list[str], stats: np.ndarray) -> dict[str, np.ndarray]:
        """The log odds of each target, at the prior of the sample."""
        x = _scaled(stats)
        found = [tokens(t) for t in texts]
        out = {}
        for t in TARGETS:
            w = self.weights[t]
            if w is None:
                out[t] = np.full(len(texts), -5.0)
            else:
                words = np.array([lexical(f, self.lexicons[t]) for f in found]).reshape(-1, 2)
                out[t] = np.clip(np.column_stack([x, words]) @ w[:-1] + w[-1], -20, 20)
        return out


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Classifier:
    """A classifier from at most so many labelled documents, those of the lowest hash of id."""
    picked = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    s = F.col("s")
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(picked), "doc_id").withColumn("s", statistics(F.col("text")))
    rows = rows.select("doc_id", "text", "quality", "toxic", *[feature(s, n).alias(n) for n in FEATURES]).limit(most).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    stats = np.array([[r[n] for n in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return Classifier([r["text"] for r in rows], stats, {"low": np.array([r["quality"] == 0 for r in rows], bool), "toxic": np.array([r["toxic"] == 1 for r in rows], bool)})


def scored(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The kept columns with z_low and z_toxic."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # bounded: two lexicons of at most LEXICON words
    rows = docs.select(*keep, text_of("text").alias("text_")).withColumn("s", statistics(F.col("text_")))
    rows = rows.select(*keep, "text_", F.array(*[feature(F.col("s"), n) for n in FEATURES]).alias("x_"))
    shape = docs.select(*keep, F.lit(0.0).alias("z_low"), F.lit(0.0).alias("z_toxic")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            for a in range(0, len(b), 1000):
                part = b.slice(a, 1000)
                x = np.array(part.column(len(keep) + 1).to_pylist(), float).reshape(-1, len(FEATURES))
                z = m.evidence(part.column(len(keep)).to_pylist(), x)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(z["low"]), pa.array(z["toxic"])], [*keep, "z_low", "z_toxic"])

    return rows.mapInArrow(work, shape)


def _chance(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def strength(sites: DataFrame, n: str, total: str, above: str, mean: str) -> float:
    """How many documents the rate above a site counts for, by the moments of rates between sites.

    Sites with the same value of above share the rate mean; their spread is taken around it.
    """
    rate, inside = F.col(total) / F.col(n), F.col(mean) * (1 - F.col(mean))
    each = sites.groupBy(above).agg(
        F.sum(n).alias("docs"), F.sum(F.col(n) * F.col(n)).alias("squares"), F.count("*").alias("count"),
        F.sum(F.col(n) * F.pow(rate - F.col(mean), 2)).alias("spread"), F.max(inside).alias("inside"),
    )
    free = F.sum(F.col("docs") - F.col("squares") / F.col("docs"))
    free, spread, chance, inside = each.agg(free, F.sum("spread"), F.sum((F.col("count") - 1) * F.col("inside")), F.sum(F.col("docs") * F.col("inside")) / F.sum("docs")).first()
    if not free or free <= 1e-9:
        return 100.0
    between = (spread - chance) / free
    return float(np.clip(inside / between - 1, 1.0, 1e5)) if between > 0 else 1e5


def posteriors(docs: DataFrame, model: Classifier, ident: str = "doc_id", host: str = "source", path: str = "lang") -> DataFrame:
    """For each row its evidence, rates of its sites, posteriors of both targets, and keep."""
    doc = stored(scored(docs.select(F.col(ident).alias("id_"), F.col(host).cast("string").alias("host_"), F.col(path).cast("string").alias("path_"), "text"), model, ["id_", "host_", "path_"]), "evidence")
    doc = doc.withColumn("host_", F.coalesce(F.concat(F.lit("="), "host_"), F.lit("-"))).withColumn("path_", F.coalesce(F.concat(F.lit("="), "path_"), F.lit("-")))
    for t in TARGETS:
        doc = doc.withColumn(f"p_{t}", _chance(F.col(f"z_{t}")))
    paths = stored(doc.groupBy("host_", "path_").agg(F.count("*").cast("double").alias("n"), *[F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS]), "paths")
    hosts = paths.groupBy("host_").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{t}").alias(f"h_{t}") for t in TARGETS])
    total = hosts.agg(F.sum("hn"), *[F.sum(f"h_{t}") for t in TARGETS]).first()
    n = total[0] or 1.0
    prior = {t: float(np.clip((total[k + 1] or 0.0) / n, 1e-4, 1 - 1e-4)) for k, t in enumerate(TARGETS)}
    sites = paths.join(hosts, "host_")
    for t in TARGETS:
        k = strength(hosts.withColumns({"all": F.lit(1), "mean": F.lit(prior[t])}), "hn", f"h_{t}", "all", "mean")
        rate = (k * prior[t] + F.col(f"h_{t}")) / (k + F.col("hn"))
        sites = sites.withColumn(f"host_{t}", rate)
        sites = sites.withColumn(f"k_{t}", F.lit(strength(sites.withColumn("mean", F.col(f"h_{t}") / F.col("hn")), "n", f"s_{t}", "host_", "mean")))
    sites = sites.drop("hn", *[f"h_{t}" for t in TARGETS])
    # Sites with over a thousandth of all documents number under HOT; the others are never skewed.
    hot = sites.where(F.col("n") * HOT > n)
    marks = hot.select("host_", "path_", F.lit(True).alias("hot_"))
    marked = doc.join(F.broadcast(marks), ["host_", "path_"], "left")
    placed = marked.where("hot_").join(F.broadcast(hot), ["host_", "path_"]).unionByName(marked.where("hot_ is null").join(sites.where(F.col("n") * HOT <= n), ["host_", "path_"]))
    out = [F.col("id_").alias(ident)]
    for t in TARGETS:
        # The path's rate without the document itself, shrunk towards its host.
        rate = (F.col(f"k_{t}") * F.col(f"host_{t}") + F.col(f"s_{t}") - F.col(f"p_{t}")) / (F.col(f"k_{t}") + F.col("n") - 1)
        rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
        z = F.col(f"z_{t}") - F.lit(float(np.log(prior[t] / (1 - prior[t])))) + _logit(rate)
        out += [F.col(f"z_{t}").alias(f"evidence_{t}"), F.col(f"host_{t}").alias(f"host_rate_{t}"), rate.alias(f"path_rate_{t}"), _chance(z).alias(f"posterior_{t}")]
    df = placed.select(*out)
    return df.withColumn("keep", (F.col("posterior_low") < 0.5) & (F.col("posterior_toxic") < 0.5))
