"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles; a shingle's count is its weight. For each
shingle, independent Poisson processes run over the bands [0,1), [1,2), [2,4), ... of weight; a
process over a band of several units is split in halves after its first point, down to single
units, and only parts below the document's count matter. Points come in ascending order and a
process stops once it passes the largest register, so a signature costs about as many points as
there are shingles and registers. Two registers agree with a chance equal to the weighted
Jaccard similarity.

Equal texts (same words) collapse first. Of each band's bucket one pivot, the member that meets
most others in all its buckets (the origin of a group of copies, as a rule), is compared with all
others by their exact multisets; linked members share a label. In buckets that then hold several
labels, all members of different labels are compared: members outside the commonest label and
those inside are dealt into blocks of bounded size, and each pair of blocks that holds members of
different labels is a cell of its own, so that no task holds more than two blocks. A pair is
skipped only within a label (labels grow within a cell too), if one bag is too small for a link
with the other, if it was compared before, or if so few registers agree that a link is as good as
impossible (see ``least_agreeing``). Only links leave a cell, at most one less than its labels.
Links and labels stay in tables; nothing of them reaches the driver.

A group with many members outside its commonest label costs comparisons (of 320 bytes each)
with the square of their number, spread over cells; no pairs are made into rows.

Defined results: a document without words (null text too) is a class of its own; one to four
words make one shingle; a class is named by its smallest id, null ids last; of rows that are
equal throughout one is kept; columns of the input keep their names. A text of any length is
signed whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.block_anchors import _doubled, _mixed
from quarry.llm.common import NEAR, SHINGLE_WORDS, Scratch, fresh, lean, let, small_batches, stored, text_of, words_of

BANDS, ROWS = 40, 8
REGISTERS = BANDS * ROWS
#: Words and rows in a block of documents that are signed together.
BLOCK_WORDS, BLOCK_ROWS = 1 << 18, 1 << 12
#: Members that are dealt to one task with their pivot.
SHARE = 128
#: Words and members of one block of a bucket; a cell holds two blocks at most.
CELL_WORDS, CELL_MEMBERS = 1 << 19, 1 << 11
#: Links for each file of labels.
ROWS = 1 << 18

_SEED = [np.uint64(k) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def word_hashes(text: Column) -> Column:
    return let(words_of(text), lambda w: F.transform(w, lambda x: F.xxhash64(x)))


def shingles(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles of documents laid end to end."""
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(words))
    two = _doubled(words, 1)
    five = _doubled(_doubled(two, 2), 4, words)
    inside = (left >= SHINGLE_WORDS)[: len(five)]
    h, d = five[inside], doc[: len(five)][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE_WORDS))
    if len(short):
        own = []
        for k in short:
            x = np.array([sizes[k]], np.uint64) * _SEED[0]
            for w in words[ends[k] - sizes[k] : ends[k]]:
                x = _mixed(x * _SEED[1] + w)
            own.append(x[0])
        h, d = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.empty(0, int)
    return d[new], h[new], np.diff(new, append=len(h))


def _start(seed: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The state of the process of a shingle over a band."""
    return _mixed(seed * _SEED[1] + low.astype(np.uint64) * _SEED[2] + high.astype(np.uint64))


def signatures(doc: np.ndarray, seed: np.ndarray, count: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The m registers of n documents: the first points, infinite without shingles."""
    register = np.full(n * m, np.inf)
    bands = [(np.arange(len(doc)), 0, 1)]
    while (some := np.flatnonzero(count > bands[-1][2])).size:
        bands.append((some, bands[-1][2], 2 * bands[-1][2]))
    e = np.concatenate([b[0] for b in bands])
    low = np.concatenate([np.full(len(b[0]), b[1]) for b in bands])
    high = np.concatenate([np.full(len(b[0]), b[2]) for b in bands])
    d, state, turn = doc[e], _start(seed[e], low, high), np.zeros(len(e), np.uint64)
    x, k, has = np.zeros(len(e)), np.zeros(len(e), np.int64), np.zeros(len(e), bool)
    while len(e):
        fresh_ = ~has
        z = _mixed(state[fresh_] + (turn[fresh_] + np.uint64(1)) * _SEED[0])
        u = ((z >> np.uint64(11)) + np.uint64(1)) * 2.0**-53
        x[fresh_] -= np.log(u) / (m * (high - low)[fresh_])
        k[fresh_] = (_mixed(z ^ _SEED[3]) >> np.uint64(33)) % np.uint64(m)
        docs = np.unique(d) if len(e) < n else slice(None)
        most = np.zeros(n)
        most[docs] = register.reshape(n, m)[docs].max(axis=1)
        go = x <= most[d]
        e, low, high, d, state, turn, x, k = (a[go] for a in (e, low, high, d, state, turn, x, k))
        unit = high - low == 1
        np.minimum.at(register, d[unit] * m + k[unit], x[unit])
        turn = turn + unit.astype(np.uint64)
        has = np.zeros(len(e), bool)
        wide = np.flatnonzero(~unit)
        if len(wide):
            middle = (low[wide] + high[wide]) // 2
            upper = (_mixed(state[wide] ^ _SEED[2]) >> np.uint64(40)) & np.uint64(1) == 1
            parts = [(np.flatnonzero(unit), low[unit], high[unit], state[unit], turn[unit], has[unit])]
            for is_upper in (False, True):
                lo, hi = (middle, high[wide]) if is_upper else (low[wide], middle)
                parts.append((wide, lo, hi, _start(seed[e[wide]], lo, hi), np.zeros(len(wide), np.uint64), upper == is_upper))
            at, low, high, state, turn, has = (np.concatenate(c) for c in zip(*parts, strict=True))
            e, d, x, k = e[at], d[at], x[at], k[at]
            go = low < count[e]
            e, low, high, d, state, turn, x, k, has = (a[go] for a in (e, low, high, d, state, turn, x, k, has))
    return register.reshape(n, m)


def band_hashes(register: np.ndarray) -> np.ndarray:
    """A hash for each band; points are rounded so that the last bits of logarithms don't count."""
    bits = register.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(register), BANDS, -1)
    h = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _SEED[0], len(register), 0)
    for r in range(bits.shape[2]):
        h = _mixed(h * _SEED[1] + bits[:, :, r])
    return h.view(np.int64)


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, words, sizes) of runs of rows with not too many words."""
    lists = batch.column(batch.schema.get_field_index(column))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    values = values.view(np.uint64) if values.dtype == np.int64 else values
    a = 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_WORDS, "right")) - 1)
        b = min(b, a + BLOCK_ROWS, len(lists))
        yield a, b, values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])
        a = b


def register_bytes(register: np.ndarray) -> np.ndarray:
    """A byte for each register; bytes of different registers agree with a chance of 1 in 256."""
    bits = register.astype(np.float32).view(np.uint32).astype(np.uint64)
    return (_mixed(bits) >> np.uint64(56)).astype(np.uint8)


def least_agreeing(near: float, m: int = REGISTERS) -> int:
    """Registers of m that agree at least, in a pair of similarity near or more.

    Registers agree independently, so their number is binomial; it falls short of this bound,
    4.5 standard deviations below its mean, with a chance below 1 in 100,000 at the threshold.
    """
    return int(m * near - 4.5 * (m * near * (1 - near)) ** 0.5)


def signed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """row, id, digest of the words, number of words, bands and register bytes of each row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for a, b, words, sizes in _blocks(batch, "words"):
                r = signatures(*shingles(words, sizes), len(sizes))
                h = band_hashes(r)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, BANDS), pa.int32()), pa.array(h.ravel()))
                keep = [batch.column(k).slice(a, b - a) for k in range(3)]
                sig = pa.array([x.tobytes() for x in register_bytes(r)], pa.binary())
                yield pa.RecordBatch.from_arrays([*keep, pa.array(sizes, pa.int64()), bands, sig], ["row", "id", "digest", "n_words", "bands", "sig"])

    t = text_of(text)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).cast("long").alias("id"), digest_of(t).alias("digest"), word_hashes(t).alias("words"))
    return rows.mapInArrow(work, "row long, id long, digest string, n_words long, bands array<long>, sig binary")


def digest_of(text: Column) -> Column:
    return F.md5(F.array_join(words_of(text), " "))


class Bag(NamedTuple):
    """A multiset of shingles: ascending hashes, their counts and the sum of these."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int


def overlap(a: Bag, b: Bag) -> float:
    """Weighted Jaccard similarity of two multisets."""
    at = np.searchsorted(b.hashes, a.hashes)
    at[at == len(b.hashes)] = 0
    same = b.hashes[at] == a.hashes
    common = int(np.minimum(a.counts[same], b.counts[at[same]]).sum())
    return common / (a.total + b.total - common)


def bagged(words: DataFrame) -> DataFrame:
    """rep, sig and the bag of each row (rep, sig, words): bytes of hashes and of counts, null where all are 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for a, b, w, sizes in _blocks(batch, "words"):
                doc, h, n = shingles(w, sizes)
                ends = np.searchsorted(doc, np.arange(len(sizes) + 1))
                parts = list(zip(ends[:-1], ends[1:], strict=True))
                counts = [None if (n[x:y] == 1).all() else n[x:y].astype(np.uint32).tobytes() for x, y in parts]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in range(2)], pa.array([h[x:y].tobytes() for x, y in parts], pa.binary()), pa.array(counts, pa.binary())], ["rep", "sig", "h", "n"])

    return words.mapInArrow(work, "rep long, sig binary, h binary, n binary")


def _bag(h: pa.Scalar, n: pa.Scalar) -> Bag:
    hashes = np.frombuffer(h.as_buffer(), np.uint64)
    counts = np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64) if n.is_valid else np.ones(len(hashes), np.int64)
    return Bag(hashes, counts, int(counts.sum()))


def star_links(pairs: DataFrame, bodies: DataFrame, near: float) -> DataFrame:
    """The pairs (a, p) of similarity near or more, lazy; bodies: rep, sig and bag.

    Members of a pivot are dealt out in shares, each after a copy of the pivot's bag, and pass
    through one by one: a task holds a batch and one pivot.
    """
    least = least_agreeing(near)
    shares = pairs.groupBy("p").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    members = pairs.join(shares, "p").select("p", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("turn"), F.col("a").alias("rep"))
    pivots = shares.select("p", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("turn"), F.col("p").alias("rep"))
    dealt = members.unionByName(pivots).join(bodies, "rep").repartition(F.col("p"), F.col("share")).sortWithinPartitions("p", "share", "turn").select("p", "turn", "rep", "sig", "h", "n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        own = sig = None
        for batch in batches:
            p, turn, rep = (batch.column(k).to_numpy() for k in range(3))
            a, q = [], []
            for k in range(len(p)):
                s = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint8)
                if turn[k] == 0:
                    # A copy: the batch's memory may go before the last member comes.
                    first = _bag(batch.column(4)[k], batch.column(5)[k])
                    own, sig = Bag(first.hashes.copy(), first.counts.copy(), first.total), s.copy()
                elif int((s == sig).sum()) >= least and overlap(_bag(batch.column(4)[k], batch.column(5)[k]), own) >= near:
                    a.append(rep[k])
                    q.append(p[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(q, pa.int64())], ["a", "p"])

    return dealt.mapInArrow(compare, "a long, p long")


class _Labels:
    """Labels of a cell's members and which of them are one by now."""

    def __init__(self, label: np.ndarray) -> None:
        self.of = np.unique(label, return_inverse=True)[1]

    def join(self, x: int, y: int) -> None:
        self.of[self.of == self.of[x]] = self.of[y]


def cell_links(pivot: int, rep: np.ndarray, label: np.ndarray, side: np.ndarray, sigs: np.ndarray, bag_of, near: float) -> list[tuple[int, int]]:
    """Links that join the labels of a cell's members as far as similarity does.

    With members of both sides only pairs across them are compared, as others meet elsewhere.
    """
    least, labels, across, bags, out = least_agreeing(near), _Labels(label), side.min() < side.max(), {}, []

    def bag(k: int) -> Bag:
        if k not in bags:
            bags[k] = bag_of(k)
        return bags[k]

    for x in range(len(rep) - 1):
        after = slice(x + 1, None)
        may = labels.of[after] != labels.of[x]
        if across:
            may &= side[after] != side[x]
        if rep[x] == pivot:
            continue
        ys = x + 1 + np.flatnonzero(may & (rep[after] != pivot))
        ys = ys[(sigs[ys] == sigs[x]).sum(axis=1) >= least] if len(ys) else ys
        for y in ys:
            if labels.of[x] == labels.of[y]:
                continue
            a, b = bag(x), bag(y)
            if min(a.total, b.total) >= near * max(a.total, b.total) and overlap(a, b) >= near:
                labels.join(x, y)
                out.append((int(rep[x]), int(rep[y])))
    return out


def cells(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, cell, side, rep, p, label): members of buckets of several labels, dealt to cells.

    Members outside the bucket's commonest label form blocks 0, 1, ..., those inside blocks after
    them; a cell is a pair of blocks with one of the first kind, or a whole small bucket.
    """
    named = members.where("size > 2").join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    each = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("bag").alias("words"))
    most = F.max(F.struct("n", "label", "words"))
    of = each.groupBy("bucket").agg(most.alias("m"), F.sum("n").alias("n"), F.sum("words").alias("words"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda words, n: f"cast(greatest(1, ceil({words} / {CELL_WORDS}), ceil({n} / {CELL_MEMBERS})) as int)"
    of = of.select(
        "bucket", F.col("m.label").alias("home"), F.expr(f"words <= {CELL_WORDS} and n <= {CELL_MEMBERS}").alias("small"),
        F.expr(blocks("(words - m.words)", "(n - m.n)")).alias("others"), F.expr(blocks("m.words", "m.n")).alias("homes"),
    )
    named = named.join(scratch.cached(of), "bucket")
    at = "pmod(xxhash64(rep), {})"
    pair = "named_struct('i', cast({} as int), 'j', cast({} as int), 'side', {})"
    first = pair.format("least(b, k)", "greatest(b, k)", "if(b <= k, 0, 1)")
    inside = f"transform(array({at.format('homes')}), b -> transform(sequence(0, others - 1), k -> {pair.format('k', 'others + b', '1')}))[0]"
    outside = f"transform(array({at.format('others')}), b -> concat(transform(sequence(0, others - 1), k -> {first}), transform(sequence(others, others + homes - 1), k -> {pair.format('b', 'k', '0')})))[0]"
    places = F.expr(f"case when small then array({pair.format('0', '0', '0')}) when label = home then {inside} else {outside} end")
    return named.withColumn("place", F.explode(places)).select("bucket", F.col("place.i").alias("i"), F.col("place.j").alias("j"), F.col("place.side").alias("side"), "rep", "p", "label")


def cross_links(dealt: DataFrame, bodies: DataFrame, near: float) -> DataFrame:
    """Links (a, p) between members of different labels in a cell, lazy."""
    held = dealt.join(bodies, "rep").repartition(F.col("bucket"), F.col("i"), F.col("j")).sortWithinPartitions("bucket", "i", "j", "rep").select("bucket", "i", "j", "p", "rep", "label", "side", "sig", "h", "n")

    def cell(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        rep, label, side = (t[c].to_numpy() for c in ("rep", "label", "side"))
        sigs = np.stack([np.frombuffer(s.as_buffer(), np.uint8) for s in t["sig"]])
        found = cell_links(int(t["p"][0].as_py()), rep, label, side, sigs, lambda k: _bag(t["h"][k], t["n"][k]), near)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "p"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come one after another and may span batches; one is held at a time."""
        lean()
        rest, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if rest and key != tuple(keys[a]):
                    yield cell(pa.Table.from_batches(rest))
                    rest = []
                key = tuple(keys[a])
                rest.append(batch.slice(a, b - a))
        if rest:
            yield cell(pa.Table.from_batches(rest))

    return held.mapInArrow(work, "a long, p long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): the smallest member of each vertex's component, from links (a, p).

    Labels pass over links and then to their own labels' labels, until nothing changes.
    """
    both = links.unionByName(links.select(F.col("p").alias("a"), F.col("a").alias("p"))).select(F.col("a").alias("v"), F.col("p").alias("u")).distinct()
    both = scratch.stored(both, "links")
    few = max(1, both.count() // ROWS)  # small tables are written to few files
    now = scratch.stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")).coalesce(few), "labels")
    while True:
        passed = both.join(now.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("near"))
        step = now.join(passed, "v", "left").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = now.select(F.col("v").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label", "left").select("v", "was", F.least("label", "up").alias("label"))
        step = scratch.stored(step.coalesce(few), "labels")
        changed = step.where("was <> label").limit(1).count()
        scratch.drop(now)
        now = step
        if not changed:
            return now.select("v", "label")


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", near: float = NEAR) -> DataFrame:
    """row, id, digest, class_id, class_size and kept for each row of docs, stored."""
    with Scratch(docs.sparkSession) as scratch, small_batches(docs.sparkSession):
        return stored(_classes(docs, ident, text, near, scratch), "classes")


def _classes(docs: DataFrame, ident: str, text: str, near: float, scratch: Scratch) -> DataFrame:
    rows = scratch.stored(signed(docs, ident, text), "signatures")
    # A digest's representative is the row of the smallest id.
    order = F.struct(F.col("id").isNull(), "id", "row")
    words = rows.where("n_words > 0")
    reps = words.groupBy("digest").agg(F.min_by(F.struct("row", "id", "n_words", "bands", "sig"), order).alias("r"), F.count("*").alias("n"))
    reps = scratch.stored(reps.select(F.col("r.row").alias("rep"), "r.id", "digest", "n", F.greatest(F.col("r.n_words") - (SHINGLE_WORDS - 1), F.lit(1)).alias("bag"), "r.bands", "r.sig"), "representatives")
    members = reps.select("rep", "bag", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.cached(members.join(sizes, "bucket"))
    degrees = scratch.cached(members.groupBy("rep").agg(F.sum("size").alias("degree")))
    involved = reps.select("rep", "id", "digest", "sig").join(degrees.select("rep"), "rep", "left_semi")
    # Rows without id are found by the digest alone, so that they don't all meet.
    also = lambda i, d: F.when(F.col(i).isNull(), d).otherwise(F.lit(""))
    body = docs.select(F.col(ident).cast("long").alias("i"), text_of(text).alias("t")).withColumn("k", also("i", digest_of(F.col("t"))))
    same = F.col("id").eqNullSafe(F.col("i")) & (also("id", F.col("digest")) == F.col("k"))
    body = involved.join(body, same).where(digest_of(F.col("t")) == F.col("digest")).dropDuplicates(["rep"])
    bodies = scratch.stored(bagged(body.select("rep", "sig", word_hashes(F.col("t")).alias("words"))), "bags")
    # The pivot is the member of the highest degree.
    ranked = members.join(degrees, "rep")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"), "bag")).alias("m")).select("bucket", (-F.col("m.r")).alias("p"), F.col("m.bag").alias("p_bag"))
    members = scratch.stored(members.join(scratch.cached(pivots), "bucket"), "members")
    pairs = members.where(f"rep <> p and least(bag, p_bag) >= {near} * greatest(bag, p_bag)").select(F.col("rep").alias("a"), "p").distinct()
    first = components(star_links(scratch.cached(pairs), bodies, near), scratch)
    found = cross_links(cells(members, first, scratch), bodies, near)
    for c in ("a", "p"):
        to = first.select(F.col("v").alias(c), F.col("label").alias("to"))
        found = found.join(to, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    second = components(found.where("a <> p"), scratch)
    label = F.coalesce("label", "rep").alias("label")
    to = second.select(F.col("v").alias("label"), F.col("label").alias("now"))
    named = reps.join(first.withColumnRenamed("v", "rep"), "rep", "left").select("digest", "rep", "id", "n", label)
    named = named.join(to, "label", "left").withColumn("label", F.coalesce("now", "label"))
    sizes = named.groupBy("label").agg(F.min_by(F.struct("id", "rep"), F.struct(F.col("id").isNull(), "id", "rep")).alias("first"), F.sum("n").alias("class_size"))
    named = named.join(sizes, "label").select("digest", F.col("first.id").alias("class_id"), F.col("first.rep").alias("keeper"), "class_size")
    known = words.join(named, "digest").select("row", "id", "digest", "class_id", "class_size", (F.col("row") == F.col("keeper")).alias("kept"))
    none = rows.where("n_words = 0").select("row", "id", "digest", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return known.unionByName(none)


def deduplicated(docs: DataFrame, ident: str = "doc_id", text: str = "text", near: float = NEAR) -> DataFrame:
    """The rows of docs of which one is kept for each class."""
    found = classes(docs, ident, text, near).where("kept").select("id", F.col("digest").alias("words_digest"))
    digest, key = fresh(docs, "digest", "key")
    body = docs.withColumn(digest, digest_of(text_of(text))).withColumn(key, F.coalesce(F.col(ident).cast("long"), F.lit(-1)))
    found = found.withColumn("id_key", F.coalesce("id", F.lit(-1)))
    out = body.join(found, (body[key] == found["id_key"]) & body[ident].cast("long").eqNullSafe(found["id"]) & (body[digest] == found["words_digest"]), "left_semi")
    # Rows equal in id and words are told apart only where there are any; empty texts stay as they are.
    again = docs.groupBy(F.col(ident).cast("long").alias("i")).count().where("count > 1").limit(1).count()
    if again:
        empty = F.md5(F.lit(""))
        out = out.where(F.col(digest) == empty).unionByName(out.where(F.col(digest) != empty).dropDuplicates([key, digest]))
    return out.select(*docs.columns)
