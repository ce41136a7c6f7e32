"""Threshold-scaled sketches of documents; DataFrame and SQL functions only.

A sketch keeps every distinct hash of a five-word shingle that lies below a fixed fraction of
the hash range, so that its size follows the text, sketches of parts merge by union, and the
share of one sketch found in another estimates containment even between very unequal texts.

``with_next`` gives each document its neighbour in descending order of id with one shuffle of
the texts: a range partitioning of the ids alone sets the bounds of groups of about equal numbers
of documents, whatever their ids are, and the first document of a group is also dealt to the group
before it. Where one id (or none) has more rows than a group should, the bounds are set by id and a
digest of the text. The driver receives a bound for each group, 2 for each shuffle partition.

Defined results: a null text is empty; a text of one to four words has one shingle, an empty
text has none and an empty sketch; a text whose hashes all lie above the threshold keeps its
smallest one; two empty sketches are alike (1.0), an empty and another one are not (0.0). Rows
of equal id are ordered by a digest of their text; a null id comes last; rows equal in both are
one group's. An empty table gives no rows; texts count whole at any length. Columns of the input
keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SHINGLE_WORDS, fresh, let, text_of, words_of

#: The fraction of the hash range that is kept: one hash of so many.
SCALED = 4
#: Groups of documents for each shuffle partition, and documents in one at least.
GROUPS, LEAST_DOCS = 2, 16

LOWEST = -(1 << 63)
LONGS = "array<bigint>"


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """A hash for each window of so many words; one for a shorter text with words."""

    def windows(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[w[i + k] for k in range(words)]))
        return F.when(F.size(w) >= words, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast(LONGS))

    return let(words_of(text), windows)


def sketch(text: Column, scaled: int = SCALED) -> Column:
    """The sorted distinct hashes below the threshold."""
    top = LOWEST + (1 << 64) // scaled

    def kept(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < F.lit(top))))
        return let(low, lambda k: F.when((F.size(k) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(k))

    return let(shingle_hashes(text), kept)


def merged(sketches: Column, scaled: int = SCALED) -> Column:
    """The sketch of all texts together, from an array of their sketches."""
    top = LOWEST + (1 << 64) // scaled

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(top))
        return F.when((F.size(low) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(low)

    return let(F.array_sort(F.array_distinct(F.flatten(sketches))), kept)


def likeness(a: Column, b: Column) -> Column:
    """The share of common hashes among all of both (Jaccard), 0 to 1."""
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both.cast("double"))


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise((F.size(F.array_intersect(a, b)) / F.size(a)).cast("double"))


def written(sketch_: Column) -> Column:
    """A sketch as text: its hashes in order, joined by commas."""
    return F.array_join(sketch_.cast("array<string>"), ",")


def _place(ident: Column, digest: Column) -> Column:
    """A string that sorts by descending id, null last, and then by digest."""
    flipped = F.lpad(F.hex(F.bitwise_not(ident.cast("long")).bitwiseXOR(F.lit(LOWEST))), 16, "0")
    return F.concat(F.coalesce(flipped, F.lit("null")), digest)


def _starts(docs: DataFrame, place: Column, n: int) -> list[str]:
    """The first place of each of at most n groups of consecutive places."""
    spread = docs.select(place.alias("p")).repartitionByRange(n, "p")
    return sorted(r["p"] for r in spread.groupBy(F.spark_partition_id()).agg(F.min("p").alias("p")).collect())


def _group(place: Column, starts: list[str]) -> Column:
    """How many of the starts after the first one lie at a place or before."""
    step = max(1, int(len(starts) ** 0.5))
    upto = lambda a: F.size(F.filter(a, lambda s: s <= place))
    coarse = upto(F.lit(starts[::step])) - 1
    return let(coarse, lambda c: c * step + upto(F.slice(F.lit(starts), c * step + 1, step)) - 1).cast("int")


def with_next(docs: DataFrame, ident: str, text: str, derive, out: str) -> tuple[DataFrame, str]:
    """docs with a struct: own, derive(text); next and next_text, those of the next document.

    The struct is named out, or like it where docs have such a column; its name is returned too.
    Descending ids; after the last comes the first.
    """
    group, copy, digest, own, at = fresh(docs, "group", "copy", "digest", out, "place")
    key, body = F.col(f"`{ident}`"), text_of(F.col(f"`{text}`"))
    n, most = docs.groupBy(key.cast("long").alias("i")).count().agg(F.sum("count"), F.max("count")).first()
    groups = max(1, min(GROUPS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n or 0) // LEAST_DOCS))
    hot = (most or 0) > max(LEAST_DOCS, (n or 0) // groups)
    place = _place(key, F.md5(body) if hot else F.lit(""))
    starts = _starts(docs, place, groups) or [""]
    dealt = docs.withColumn(at, place)
    mine, first = _group(F.col(at), starts), F.col(at).isin(starts)
    both = let(mine, lambda g: F.array_compact(F.array(
        F.struct(g.alias("g"), F.lit(0).alias("c")),
        F.when(first, F.struct(F.pmod(g - 1, F.lit(len(starts))).alias("g"), F.lit(1).alias("c"))),
    )))
    dealt = dealt.withColumn(group, F.explode(both))
    dealt = dealt.withColumn(copy, F.col(f"{group}.c")).withColumn(group, F.col(f"{group}.g")).repartition(F.col(group))
    dealt = dealt.withColumn(digest, F.md5(body)).withColumn(own, derive(body))
    w = Window.partitionBy(group).orderBy(F.col(copy), F.col(at), F.col(digest))
    dealt = dealt.withColumn(own, F.struct(F.col(own).alias("own"), F.lead(own).over(w).alias("next"), F.lead(body).over(w).alias("next_text")))
    return dealt.where(F.col(copy) == 0).drop(group, copy, digest, at), own


def edited(text: Column, following: Column) -> Column:
    """The text with its last third (rounded down) replaced by as much of the following one's start."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - third), F.substr(following, F.lit(1), third))
