"""Learned decision lists over text statistics (quality rules).

``statistics`` computes countable facts of each text inside its row, without a shuffle.
``learn`` turns labelled statistics into an ordered list of threshold conjunctions by
sequential covering: each rule is grown on one part of the sample by information gain and
pruned on the rest, then what it covers is set aside. ``verdict`` writes the list as one
Spark conditional expression.

Defined results: a null or empty text has no words and fails the base rules; ties between
equally good conditions go to the earlier feature and lower threshold; repeated rows get the
same verdict each; without labels of both kinds, or without documents, the list is empty and
the base rules alone decide. Columns of the input keep their names and values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, let, text_of, words_of

#: Labelled rows that the learner reads at most, and where it stops.
MAX_LABELLED = 12_000
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 48
MIN_PRECISION = 0.9
MIN_COVERED = 8

FEATURES = ("n_words", "mean_word", "symbols", "dup_lines", "repeats", "capitals", "marks")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        step = F.transform(starts, lambda a, i: F.when(i == n - 1, F.lit(3)).otherwise(F.least(F.lit(3), starts[i + 1] - a)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda total, k: total + k)

    def in_pairs(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda e, i: ((i > 0) & (s[i - 1]["h"] == e["h"])) | ((i < n - 1) & (s[i + 1]["h"] == e["h"])))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def among(hashes: Column) -> Column:
        """Few repeated hashes are looked up one by one; many are found by sorting with places."""
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        few = lambda twice: F.array_compact(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)))
        return let(
            let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, i: (i > 0) & (s[i - 1] == h)))),
            lambda twice: F.when(F.size(twice) == 0, F.lit(0).cast("long")).when(F.size(twice) <= 16, let(few(twice), covered)).otherwise(let(ordered, in_pairs)),
        )

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(windows, among))


def statistics(text: Column) -> Column:
    """A struct of counts for one text, all long."""
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    dup = let(F.filter(F.split(text, "\n"), has_word), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    only = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", ""))
    by_word = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    return let(
        by_word,
        lambda s: F.struct(
            s["n_words"].alias("n_words"),
            s["word_chars"].alias("word_chars"),
            only(r"#*$%&|<>").cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            s["n_repeat_words"].alias("n_repeat_words"),
            only(r"\p{Lu}").cast("long").alias("n_capitals"),
            only(r"!?;:\"'()\[\]{}").cast("long").alias("n_marks"),
            F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        ),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def feature(s: Column, name: str) -> Column:
    """A feature as a double; shares are 0 where the text is empty."""
    share = lambda a, b: F.coalesce(F.try_divide(s[a].cast("double"), s[b]), F.lit(0.0))
    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "word_chars"),
    }[name]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.cut if self.above else x <= self.cut

    def column(self, s: Column) -> Column:
        x = feature(s, self.feature)
        return x > F.lit(self.cut) if self.above else x <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    inside = np.ones(n, bool)
    for c in rule:
        inside &= c.holds(table)
    return inside


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray) -> Rule:
    """Add the condition of the highest gain until only bad rows remain."""
    rule: Rule = ()
    inside = left.copy()
    while len(rule) < MAX_CONDITIONS:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        best, best_gain = None, 1e-9
        for name in FEATURES:
            x = table[name]
            own = np.unique(np.quantile(x[inside & bad], np.linspace(0, 1, CUTS)))
            for cut in np.unique(np.concatenate([own, np.quantile(x[inside], np.linspace(0, 1, CUTS))])):
                over = x > cut
                for above in (True, False):
                    hit = inside & (over if above else ~over)
                    p1, n1 = int((hit & bad).sum()), int((hit & ~bad).sum())
                    if p1 < MIN_COVERED:
                        continue
                    gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                    if gain > best_gain:
                        best, best_gain = Condition(name, above, float(cut)), gain
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(table)
    return rule


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray) -> tuple[float, int]:
    inside = left & _covers(rule, table, len(bad))
    p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
    return (p + 1) / (p + n + 2), p


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Sequential covering of the bad rows; every third row is kept for pruning."""
    rules: list[Rule] = []
    if not bad.any() or bad.all():
        return rules
    held = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & bad & ~held).sum() >= MIN_COVERED:
        rule = _grow(table, bad, left & ~held)
        if not rule:
            break
        shorter = [rule[: k + 1] for k in range(len(rule))]
        scored = [_worth(r, table, bad, left & held) for r in shorter]
        rule = shorter[max(range(len(rule)), key=lambda k: (scored[k][0], -k))]
        every, found = _worth(rule, table, bad, left)
        if every < MIN_PRECISION or found < MIN_COVERED:
            break
        rules.append(rule)
        left &= ~_covers(rule, table, len(bad))
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules that reject documents of quality 0, from at most max_labelled labelled rows.

    The sample is the labelled ids of the lowest hash; its size bounds both the broadcast of
    ids and what the driver receives.
    """
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    s = F.col("s")
    # Documents that fail the base rules go after they are here: as a filter their statistics would
    # be computed below the join, for all documents.
    rows = (
        docs.select("doc_id", F.col("text").alias("text"))
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", "quality", statistics(text_of("text")).alias("s"))
        .select("doc_id", "quality", base_failed(s).alias("failed"), *[feature(s, n).alias(n) for n in FEATURES])
        .orderBy(F.xxhash64("doc_id"), "failed", *FEATURES)
        .limit(max_labelled)
        .collect()
    )
    rows = [r for r in rows if not r["failed"]]
    table = {n: np.array([r[n] for r in rows], float) for n in FEATURES}
    return learn_rules(table, np.array([r["quality"] == 0 for r in rows], bool))


def verdict(s: Column, rules: list[Rule]) -> Column:
    """The number of the first rule that holds, counted from 1; 0 where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column(s)
        for c in rule[1:]:
            holds = holds & c.column(s)
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with a struct of statistics and a struct (base_failed, rule, kept); and their names."""
    stats, result = fresh(docs, "stats", "result")
    df = docs.withColumn(stats, statistics(text_of(F.col(f"`{text}`"))))
    s = F.col(stats)
    failed, rule = base_failed(s), verdict(s, rules)
    df = df.withColumn(result, F.struct(failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept")))
    return df, stats, result
