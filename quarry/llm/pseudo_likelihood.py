"""Language-model scores by masked pseudo-likelihood.

A bidirectional window network, written and trained in numpy, predicts every token from the two
before and the two after it; the sum of the conditional log-probabilities scores a document.

Tokens are words: the most frequent ones of the corpus have ids of their own, others share
buckets by hash. Word counts cover all documents and set the vocabulary and the output's first
biases. A word of a bucket gets its share of the bucket's probability, by the counts of all words:
the most frequent ``KNOWN`` counts are in memory, all others stay in a table and are joined by hash. Of n words in a bucket each counts half an
occurrence more than it has, and so do n + 1 words that were never seen; the shares of all these
add up to 1. Training covers all documents and all their positions: a round's share of the positions
is predicted from the words around them, and each position is in exactly one round. In each round
every partition starts from the shared weights; weights of all partitions are averaged as a tree of
two levels, in proportion to the positions seen. What is gathered thus grows with the input, and only
weights of a fixed size reach the driver. Probabilities are of two steps, a class of ids and an id
within it, and for words of buckets of a third. The texts are split into words twice, for the counts
and for the ids; ids are stored and serve all rounds and the scores.

Each partition learns from its own documents, so scores depend on how documents are dealt to
partitions; the same files read the same way give the same scores, also where tasks are run again.

Defined results: a null or empty text has no tokens, sum 0 and a null mean; equal rows get equal
scores; an empty table gives an empty result; texts count whole at any length (a task holds one of
them at least); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bag_minhash import _blocks, word_hashes
from quarry.llm.block_anchors import _mixed
from quarry.llm.common import BLANKS, stored, text_of

CLASS = 64
FREQUENT, BUCKETS = 48 * CLASS, 16 * CLASS
IDS = FREQUENT + BUCKETS
PAD = IDS
SIZE, HIDDEN = 24, 32
AROUND = (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 2, 4096, 0.05
#: Words at most whose counts are broadcast, and steps of counts, in each doubling, by which they are chosen.
KNOWN, STEPS = 1 << 18, 16
#: Logarithms of counts are summed in units of 1 / UNIT, so that the order of rows does not matter.
UNIT = 1 << 24
#: Places of a block of documents that follow each other in training.
MIXED = 64
#: Numbers of weights in one block that is averaged.
BLOCK = 1 << 13

SHAPES = {
    "embed": (IDS + 1, SIZE),
    "hide": (len(AROUND) * SIZE, HIDDEN),
    "hide_b": (HIDDEN,),
    "top": (HIDDEN, IDS // CLASS),
    "top_b": (IDS // CLASS,),
    "in": (IDS // CLASS, HIDDEN, CLASS),
    "in_b": (IDS // CLASS, CLASS),
}

Weights = dict[str, np.ndarray]


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES]).astype(np.float32)


def unflat(x: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).copy()
        at += n
    return out


def first_weights(counts: np.ndarray) -> Weights:
    """Small random weights, and biases that give each id its share of the counts."""
    rng = np.random.default_rng(1)
    w = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    w["embed"][PAD] = 0
    by_class = (counts + 0.5).reshape(-1, CLASS)
    w["top_b"] = np.log(by_class.sum(1) / by_class.sum()).astype(np.float32)
    w["in_b"] = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
    w["hide_b"] = np.zeros(HIDDEN, np.float32)
    return w


class Vocabulary:
    """Ids of word hashes, and what the words of each bucket add up to."""

    def __init__(self, top: list[tuple[int, int]], buckets: list[tuple[int, int, int]], counted: tuple[np.ndarray, np.ndarray] = ((), ())) -> None:
        """top: (hash, count); buckets: (bucket, count of its words, how many different ones); counted: hashes and counts of words."""
        known = np.array([h for h, _ in top], np.int64).view(np.uint64)
        self.order = np.argsort(known)
        self.known = known[self.order]
        counts = np.zeros(IDS)
        counts[: len(top)] = [n for _, n in top]
        self.share_of = np.full(BUCKETS, 0.5)
        for b, n, different in buckets:
            counts[FREQUENT + b] = n
            self.share_of[b] += n + different
        self.counts = counts
        h, n = np.asarray(counted[0], np.int64).view(np.uint64), np.asarray(counted[1], np.int64)
        order = np.argsort(h)
        self.counted, self.units = h[order], np.rint(np.log(n[order] + 0.5) * UNIT).astype(np.int64)

    def shares(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of the logarithm of the words' counts, 0 where they are not in memory; and where they are."""
        if not len(self.counted):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.counted, h), len(self.counted) - 1)
        here = self.counted[at] == h
        return np.where(here, self.units[at], 0), here

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = FREQUENT + ((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            out = np.where(self.known[at] == h, self.order[at], out)
        return out


def contexts(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """For each position (or those at) of documents laid end to end the ids around it, PAD beyond its document."""
    n = len(ids)
    wide, docs = np.full(n + 4, PAD, np.int16), np.full(n + 4, -1, np.int32)
    wide[2:-2], docs[2:-2] = ids, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    own = docs[2:-2] if at is None else docs[at + 2]
    out = np.empty((len(own), len(AROUND)), np.int16)
    for column, k in enumerate(AROUND):
        near = slice(2 + k, 2 + k + n) if at is None else at + (2 + k)
        out[:, column] = np.where(docs[near] == own, wide[near], np.int16(PAD))
    return out


def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def _lowered(x: np.ndarray) -> np.ndarray:
    """x less the largest of each row, in place, where exp(x) could overflow; as it is elsewhere."""
    if len(x) and float(x.max()) > 60 or len(x) and float(x.min()) < -60:
        x -= x.max(axis=1, keepdims=True)
    return x


class Space:
    """Arrays of 32-bit floats by name, kept for the next batch: fresh ones cost more than the sums they hold."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def _rows(space: Space, name: str, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """of[at] for places in range."""
    return np.take(of, at, axis=0, out=space(name, len(at), of.shape[1]), mode="clip")


def _forward(w: Weights, around: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    n = len(around)
    x = _rows(space, "x", w["embed"], around.ravel()).reshape(n, -1)
    h = np.matmul(x, w["hide"], out=space("h", n, HIDDEN))
    h += w["hide_b"]
    return x, np.tanh(h, out=h)


def _outer(w: Weights, h: np.ndarray, space: Space) -> np.ndarray:
    """The scores of classes."""
    out = np.matmul(h, w["top"], out=space("top", len(h), IDS // CLASS))
    out += w["top_b"]
    return out


def _class_edges(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes that occur in ascending classes, and where each starts and ends."""
    present = np.flatnonzero(np.bincount(classes, minlength=IDS // CLASS))
    return present, np.searchsorted(classes, np.append(present, IDS))


def _inner(w: Weights, h: np.ndarray, present: np.ndarray, edges: np.ndarray, space: Space) -> np.ndarray:
    """Of rows in order of class, the scores of the ids within their class."""
    out = space("inner", len(h), CLASS)
    for c, a, b in zip(present, edges[:-1], edges[1:], strict=True):
        np.matmul(h[a:b], w["in"][c], out=out[a:b])
        out[a:b] += w["in_b"][c]
    return out


def _log_share(scores: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """The logarithm of the softmax of each row at its place; scores are used up. small: none can overflow."""
    if not small:
        _lowered(scores)
    own = scores[np.arange(len(at)), at]
    np.exp(scores, out=scores)
    return own - np.log(scores @ _ones(scores.shape[1]))


def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether scores stay within what exp can take: the hidden layer lies between -1 and 1."""
    return float((np.abs(weights).sum(axis=-2) + np.abs(bias)).max()) < 60


def log_probabilities(w: Weights, ids: np.ndarray, around: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """The logarithm of each id's probability given those around it."""
    out, space = np.empty(len(ids), np.float32), Space()
    classes = (ids // CLASS).astype(np.int16)
    # Each neighbour's part of the hidden layer, by place and id, is made once for all positions.
    parts = np.matmul(w["embed"], w["hide"].reshape(len(AROUND), SIZE, HIDDEN))
    parts[0] += w["hide_b"]
    small = [_small(w["top"], w["top_b"]), _small(w["in"], w["in_b"])]
    for a in range(0, len(ids), step):
        order = a + np.argsort(classes[a : a + step], kind="stable")
        c, near = classes[order], around[order]
        h = _rows(space, "h", parts[0], near[:, 0])
        for k in range(1, len(AROUND)):
            h += _rows(space, "x", parts[k], near[:, k])
        np.tanh(h, out=h)
        out[order] = _log_share(_outer(w, h, space), c, small[0]) + _log_share(_inner(w, h, *_class_edges(c), space), ids[order] % CLASS, small[1])
    return out


class Learner:
    """Adagrad steps on positions and the ids around them."""

    def __init__(self, w: Weights, rate: float = RATE) -> None:
        self.w, self.rate = w, rate
        self.seen = {k: np.full(s, 1e-6, np.float32) for k, s in SHAPES.items()}
        self.positions, self.space = 0, Space()

    def _move(self, k: str, g: np.ndarray, at=slice(None)) -> None:
        seen, by = self.seen[k][at], self.space("by", *g.shape)
        seen += np.multiply(g, g, out=by)
        if not isinstance(at, slice):
            self.seen[k][at] = seen
        np.divide(g, np.sqrt(seen, out=by), out=by)
        by *= self.rate
        self.w[k][at] -= by

    def step(self, ids: np.ndarray, around: np.ndarray) -> None:
        w, n = self.w, len(ids)
        classes = (ids // CLASS).astype(np.int16)
        order = np.argsort(classes, kind="stable")
        ids, around, classes, each = ids[order], around[order], classes[order], np.arange(n)
        present, edges = _class_edges(classes)
        space = self.space
        x, h = _forward(w, around, space)
        p, q = _outer(w, h, space), _inner(w, h, present, edges, space)
        for scores, at in ((p, classes), (q, ids % CLASS)):
            np.exp(_lowered(scores), out=scores)
            scores *= (1 / (n * (scores @ _ones(scores.shape[1]))))[:, None]
            scores[each, at] -= np.float32(1 / n)
        dh = np.matmul(p, w["top"].T, out=space("dh", n, HIDDEN))
        inner = space("d_in", *SHAPES["in"])
        inner[:] = 0
        back, inner_b, ones = space("back", n, HIDDEN), np.zeros(SHAPES["in_b"], np.float32), _ones(n)
        for c, a, b in zip(present, edges[:-1], edges[1:], strict=True):
            np.matmul(q[a:b], w["in"][c].T, out=back[a:b])
            np.matmul(h[a:b].T, q[a:b], out=inner[c])
            np.matmul(ones[a:b], q[a:b], out=inner_b[c])
        dh += back
        slope = np.multiply(h, h, out=space("slope", n, HIDDEN))
        dh *= np.subtract(1, slope, out=slope)
        dx = np.matmul(dh, w["hide"].T, out=space("dx", n, len(AROUND) * SIZE)).reshape(-1, SIZE)
        every = around.ravel()
        order = np.argsort(every, kind="stable")
        ascending = every[order]
        first = np.flatnonzero(np.diff(ascending, prepend=np.int16(-1)))
        rows = ascending[first]
        g = np.add.reduceat(_rows(space, "sorted", dx, order), first, axis=0)
        real = rows != PAD
        moves = [("top", h.T @ p, slice(None)), ("top_b", ones @ p, slice(None)), ("in", inner, slice(None)), ("in_b", inner_b, slice(None))]
        moves += [("hide", x.T @ dh, slice(None)), ("hide_b", ones @ dh, slice(None)), ("embed", g[real], rows[real])]
        for k, g, at in moves:
            self._move(k, g, at)
        self.positions += n


class Model(NamedTuple):
    """The network and the counts (h, n) of the words that are not in memory."""

    vocabulary: Vocabulary
    weights: Weights
    rare: DataFrame


def counted(docs: DataFrame, text: str) -> tuple[Vocabulary, DataFrame]:
    """The most frequent words of all documents, and the counts of those that are not in memory.

    The driver receives at most ``FREQUENT`` + ``KNOWN`` words, ``BUCKETS`` sums, and how many words
    there are of each step of counts.
    """
    # As in words_of, but hashed after the explode, in generated code.
    words = docs.select(F.explode(F.split(text_of(text), BLANKS)).alias("w")).where("w <> ''").groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("n"))
    words = stored(words, "counts")
    top = [(r["h"], r["n"]) for r in words.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()]
    h, n = top[-1] if top else (0, 0)
    rare = words.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("h") > h)))
    bucket = (F.shiftrightunsigned("h", 20) % BUCKETS).cast("int").alias("b")
    sums = rare.groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()
    step = F.floor(F.log2("n") * STEPS)
    least, held = 1 << 20, 0
    for r in sorted(rare.groupBy(step.alias("step")).count().collect(), reverse=True):
        if held + r["count"] > KNOWN:
            break
        least, held = r["step"], held + r["count"]
    often = rare.where(step >= least).toArrow()
    counted_ = (often["h"].to_numpy(), often["n"].to_numpy())
    return Vocabulary(top, [tuple(r) for r in sums], counted_), rare.where(step < least)


HELD = "ids array<smallint>, h array<long>, shares long"


def prepared(docs: DataFrame, vocabulary: Vocabulary, ident: str, text: str) -> DataFrame:
    """Stored: row, id, the ids of its words; of its words without ids, the units of counts in memory, and the hashes of others."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of a fixed size
    kind = docs.schema[ident].dataType.simpleString()

    def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for a, b, words, sizes in _blocks(batch, "words"):
                ids = v.ids(words)
                at = np.flatnonzero(ids >= FREQUENT)
                ends = np.cumsum(sizes)
                units, here = v.shares(words[at])
                sums = np.concatenate([[0], np.cumsum(units)])
                until = np.searchsorted(at, ends)
                units = sums[until] - sums[np.concatenate([[0], until[:-1]])]
                at = at[~here]
                columns = [lists(ids.astype(np.int16), ends, pa.int16()), lists(words[at].view(np.int64), np.searchsorted(at, ends), pa.int64()), pa.array(units, pa.int64())]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in range(2)], *columns], ["row", "id", "ids", "h", "shares"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), word_hashes(text_of(text)).alias("words"))
    return stored(rows.mapInArrow(work, f"row long, id {kind}, {HELD}"), "word-ids")


def _averaged(parts: DataFrame, partitions: int) -> np.ndarray | None:
    """The mean of the weights of all partitions (part, block, n, w), by their positions n.

    Two levels: a task adds up about as many blocks as the square root of the partitions, in their
    order, so that the sums are the same whenever they are made.
    """
    salts = max(1, int(partitions**0.5))

    def total(t: pa.Table) -> pa.Table:
        order = np.argsort(t["part"].to_numpy())
        n = t["n"].to_numpy()[order]
        sums = sum(np.frombuffer(t["w"][int(k)].as_buffer(), np.float64) for k in order)
        return pa.table({"part": pa.array([int(t["part"][int(order[0])].as_py())], pa.int32()), "block": t["block"].slice(0, 1), "n": pa.array([int(n.sum())], pa.int64()), "w": pa.array([sums.tobytes()], pa.binary())})

    shape = "part int, block int, n long, w binary"
    some = parts.withColumn("salt", F.pmod("part", F.lit(salts))).groupBy("block", "salt").applyInArrow(total, shape)
    rows = some.groupBy("block").applyInArrow(total, shape).collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["w"], np.float64) / r["n"] for r in sorted(rows, key=lambda r: r["block"])]).astype(np.float32)


def fitted(held: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights from all prepared documents; each position is a target in one of the rounds."""
    spark = held.sparkSession
    weights = flat(first_weights(vocabulary.counts))
    ids = held.select("row", "ids")
    partitions = ids.rdd.getNumPartitions()

    def round_(turn: int, start: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(start)  # of a fixed size

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            learner = Learner(unflat(shared.value), RATE / (1 + turn))
            held_ids, held_around = [], []
            for batch in batches:
                rows = batch.column(0).to_numpy().view(np.uint64)
                for a, b, ids, sizes in _blocks(batch, "ids"):
                    # Each round takes every so manieth position of a document, from a place that its row
                    # sets, so that a retried task takes the same; those of far documents alternate.
                    shift = (_mixed(rows[a:b] + np.uint64(1)) >> np.uint64(33)).astype(np.int64) - (np.cumsum(sizes) - sizes)
                    at = np.flatnonzero((np.arange(len(ids)) + np.repeat(shift, sizes)) % rounds == turn)
                    far = len(at) // MIXED * MIXED
                    at = np.concatenate([at[:far].reshape(MIXED, -1).T.ravel(), at[far:]])
                    held_ids.append(ids[at])
                    held_around.append(contexts(ids, sizes, at))
                    i, c = np.concatenate(held_ids), np.concatenate(held_around)
                    whole = len(i) // BATCH * BATCH
                    for k in range(0, whole, BATCH):
                        learner.step(i[k : k + BATCH], c[k : k + BATCH])
                    held_ids, held_around = [i[whole:]], [c[whole:]]
            if held_ids and len(held_ids[0]):
                learner.step(held_ids[0], held_around[0])
            if n := learner.positions:
                w = flat(learner.w).astype(np.float64) * n
                blocks = [w[k : k + BLOCK].tobytes() for k in range(0, len(w), BLOCK)]
                part = [TaskContext.get().partitionId()] * len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array([n] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], ["part", "block", "n", "w"])

        found = _averaged(ids.mapInArrow(work, "part int, block int, n long, w binary"), partitions)
        return start if found is None else found

    for turn in range(rounds):
        weights = round_(turn, weights)
    return unflat(weights)


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Vocabulary and weights from all documents."""
    vocabulary, rare = counted(docs, text)
    held = prepared(docs.select(text).withColumn("id", F.lit(0)), vocabulary, "id", text)
    return Model(vocabulary, fitted(held, vocabulary, rounds), rare)


def scores(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its id, n_tokens, log_likelihood and mean_log_probability."""
    return _scored(prepared(docs, model.vocabulary, ident, text), model, ident)


def trained_scores(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The scores of docs under a model of these docs; their words are made into ids once."""
    vocabulary, rare = counted(docs, text)
    held = prepared(docs, vocabulary, ident, text)
    return _scored(held, Model(vocabulary, fitted(held, vocabulary), rare), ident)


def _scored(held: DataFrame, model: Model, ident: str) -> DataFrame:
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast((model.vocabulary.share_of, model.weights))  # of a fixed size
    kind = held.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share_of, w = shared.value
        of_bucket = np.log(share_of)
        for batch in batches:
            for a, b, ids, sizes in _blocks(batch, "ids"):
                p = log_probabilities(w, ids, contexts(ids, sizes)).astype(np.float64)
                at = np.flatnonzero(ids >= FREQUENT)
                p[at] -= of_bucket[ids[at] - FREQUENT]
                sums = np.concatenate([[0.0], np.cumsum(p)])
                ends = np.cumsum(sizes)
                total = np.where(sizes > 0, sums[ends] - sums[ends - sizes], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(total), batch.column(3).slice(a, b - a)], ["row", "id", "n_tokens", "network", "units"])

    network = held.select("row", "id", "ids", "shares").mapInArrow(work, f"row long, id {kind}, n_tokens long, network double, units long")
    # Words of no count are unseen ones; a table of words serves as hash map, so that occurrences are not sorted.
    known = F.round(F.log(F.coalesce(F.col("n"), F.lit(0)) + 0.5) * UNIT).cast("long")
    words = held.select("row", F.explode("h").alias("h")).join(model.rare.hint("shuffle_hash"), "h", "left")
    shares = words.groupBy("row").agg(F.sum(known).alias("shares"))
    total = F.col("network") + (F.col("units") + F.coalesce(F.col("shares"), F.lit(0))) / UNIT
    rows = network.join(shares, "row", "left").select("id", "n_tokens", total.alias("log_likelihood"))
    return rows.select(F.col("id").alias(ident), "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_probability"))
