"""Removal of repeated passages by fixed-block anchors (substring dedup).

A window of 20 words that also starts earlier covers a passage to remove. Every such window
holds a block of 10 words that starts at a multiple of 10 in the document it repeats, so blocks
at multiples of 10 are the index, every window of 10 words probes it, and only windows of 20
around a hit are extended and compared in full. Runs of such windows are the maximal repeats.

Documents are dealt to groups by id once; that exchange serves all three passes over the texts.
There are as many groups as shuffle partitions, and more where these would hold more than
``GROUP_BYTES`` of text each. Where an id (or none) has several rows, documents are dealt by id and
words, so that no id makes a large group, and messages carry a digest that orders such rows.

1. Each group sends each distinct block hash once, with a mark if it stands at a multiple of 10,
   to the bucket of the hash; the bucket tells the groups which of theirs have a partner.
2. Each group sends the hash of each distinct 20-word window around a hit once, with the smallest
   id that holds it, to its bucket; the bucket tells all groups but the first to remove it.
3. Each group marks the words of such windows and of its own later copies.

There are never more messages than hashes. As a group sends a hash once, a passage that a third of all documents share costs a bucket as
many entries as there are groups. Hashes travel sorted, as differences in planes of bytes.
Window hashes have 64 bits, made from 64-bit hashes of words.

Defined results: a null text has no words; a document of fewer than 20 words loses none; ids are
in order of their value, null last; rows that share an id are documents in order of their text,
and rows that are equal in both id and words count as one and give equal results; an empty table
gives no rows; a text of any length is one group's as a whole; columns other than id and text are
passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, lean, let, text_of, words_of

WINDOW, BLOCK = 20, 10
LAST_ID = (1 << 63) - 1  # stands for a null id
#: Bytes of text that a group holds on average at most.
GROUP_BYTES = 1 << 23

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _K[1]
    x ^= x >> np.uint64(32)
    return x


def _doubled(h: np.ndarray, step: int, other: np.ndarray | None = None) -> np.ndarray:
    """Hashes of windows of h followed, step words on, by windows of other (or h)."""
    other = h if other is None else other
    n = min(len(h), len(other) - step)
    return _mixed(h[:n] * _K[0] + other[step : step + n]) if n > 0 else np.empty(0, np.uint64)


def window_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of 10 and of 20 words in a row of word hashes."""
    two = _doubled(words, 1)
    four = _doubled(two, 2)
    five = _doubled(four, 4, words)
    ten = _doubled(five, 5)
    return ten, _doubled(ten, BLOCK)


def packed(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences, byte plane by byte plane."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return d.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def from_planes(data, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def unpacked(data, dtype) -> np.ndarray:
    return np.cumsum(from_planes(data, dtype), dtype=dtype)


class Group:
    """The documents of one group as one row of word hashes, in order."""

    def __init__(self, t: pa.Table, ident: str, hashes: str, ties: bool) -> None:
        """ties: rows of other groups may share an id with rows here."""
        ids = pc.fill_null(t[ident].cast(pa.int64()), LAST_ID).to_numpy()
        lists = t[hashes].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays([lists])
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(offsets)
        # Rows of equal id are ordered by a digest of their words; equal rows count once.
        order = np.argsort(ids, kind="stable")
        same = np.zeros(len(ids), bool)
        self.tie = np.zeros(len(ids), np.uint64)
        if ties:
            key = [hashlib.sha256(values[a:b].tobytes()).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            self.tie = np.array([int.from_bytes(k[:8], "big") for k in key], np.uint64)
            order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], key[k], k)), np.int64)
            for a, b in zip(order[:-1], order[1:], strict=True):
                same[b] = ids[a] == ids[b] and key[int(a)] == key[int(b)]
        self.rows = order[~same[order]]  # of documents, in order
        self.first_of = np.empty(len(ids), np.int64)  # document of each row
        self.first_of[order] = np.cumsum(~same[order]) - 1
        self.ids, self.sizes, self.tie = ids[self.rows], sizes[self.rows], self.tie[self.rows]
        self.ends = np.cumsum(self.sizes)
        starts = self.ends - self.sizes
        total = int(self.ends[-1]) if len(self.ends) else 0
        self.words = values[np.repeat(offsets[self.rows] - starts, self.sizes) + np.arange(total)]
        self.doc = np.repeat(np.arange(len(self.rows), dtype=np.int32), self.sizes)
        place = np.arange(total, dtype=np.int32) - np.repeat(starts.astype(np.int32), self.sizes)
        left = np.repeat(self.sizes.astype(np.int32), self.sizes) - place
        self.ten, self.twenty = window_hashes(self.words)
        self.in_ten, self.in_twenty = (left >= BLOCK)[: len(self.ten)], (left >= WINDOW)[: len(self.twenty)]
        self.aligned = (place % BLOCK == 0)[: len(self.ten)]

    def block_keys(self, buckets: int) -> np.ndarray:
        """Bucket and 31 bits of hash of each window of 10 words."""
        return ((self.ten >> np.uint64(33)) % np.uint64(buckets) << np.uint64(31)) | (self.ten & np.uint64(0x7FFFFFFF))


def _sent(keys: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of equal bucket in ascending keys."""
    at = np.searchsorted(keys, cuts)
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), int(at[b]), int(at[b + 1])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


MESSAGE = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("h", pa.binary()), ("d", pa.binary())])
MESSAGE_DDL = "b int, g int, h binary, d binary"


def _anchors(buckets: int, ident: str, hashes: str, ties: bool):
    def run(t: pa.Table) -> pa.Table:
        lean()
        g = t["g"][0].as_py()
        x = Group(t, ident, hashes, ties)
        keys = (x.block_keys(buckets)[x.in_ten] << np.uint64(1)) | (~x.aligned[x.in_ten]).astype(np.uint64)
        keys.sort()
        # Of equal hashes the first is kept: it stands at a multiple of 10 if any does.
        keys = keys[np.diff(keys >> np.uint64(1), prepend=np.uint64(1 << 63)) != 0]
        cuts = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)
        return _table([(b, g, packed((keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), None) for b, i, j in _sent(keys, cuts)], MESSAGE)

    return run


def _partners(t: pa.Table) -> pa.Table:
    """For each group its block hashes that another group has too, if any of them is in the index."""
    b, groups = t["b"][0].as_py(), t["g"].to_pylist()
    parts = [unpacked(h.as_buffer(), np.uint32) for h in t["h"]]
    every = np.concatenate(parts)
    order = np.argsort(every >> np.uint32(1), kind="stable")
    h = every[order] >> np.uint32(1)
    first = np.flatnonzero(np.diff(h, prepend=np.uint32(0xFFFFFFFF)) != 0)
    indexed = np.bitwise_or.reduceat((every[order] & np.uint32(1)) == 0, first) if len(first) else np.empty(0, bool)
    size = np.diff(first, append=len(h))
    hit = np.empty(len(h), bool)
    hit[order] = np.repeat(indexed & (size > 1), size)
    at, rows = 0, []
    for g, p in zip(groups, parts, strict=True):
        mine = p[hit[at : at + len(p)]] >> np.uint32(1)
        at += len(p)
        if len(mine):
            rows.append((b, g, packed(mine), None))
    return _table(rows, MESSAGE)


def _isin(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in among, which ascends."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _extended(buckets: int, ident: str, hashes: str, ties: bool):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(t):
            return _table([], MESSAGE)
        lean()
        g = t["g"][0].as_py()
        x = Group(t, ident, hashes, ties)
        keys = x.block_keys(buckets)
        own = np.sort(keys[x.in_ten])
        hits = [own[1:][own[1:] == own[:-1]]]
        for b, h in zip(replies["b"].to_pylist(), replies["h"], strict=True):
            hits.append(unpacked(h.as_buffer(), np.uint32).astype(np.uint64) | np.uint64(b << 31))
        hit = _isin(keys, np.unique(np.concatenate(hits))) & x.in_ten
        seen = np.concatenate([[0], np.cumsum(hit)])
        n = len(x.twenty)
        near = (seen[BLOCK + 1 : BLOCK + 1 + n] - seen[:n] > 0) & x.in_twenty
        at = np.flatnonzero(near)
        h, k = np.unique(x.twenty[at], return_index=True)
        first = x.doc[at[k]]
        # Buckets are ranges of the hash, so each one's share stays sorted.
        span = (1 << 64) // buckets + 1
        cuts = np.array([min(b * span, (1 << 64) - 1) for b in range(buckets)] + [(1 << 64) - 1], np.uint64)
        rows = []
        for b, i, j in _sent(h, cuts):
            j = len(h) if b == buckets - 1 else j
            rows.append((b, g, packed(h[i:j]), planes(x.ids[first[i:j]]) + (planes(x.tie[first[i:j]]) if ties else b"")))
        return _table(rows, MESSAGE)

    return run


def _later(ties: bool):
    def run(t: pa.Table) -> pa.Table:
        """For each group its window hashes that an earlier document in another group has."""
        b, groups = t["b"][0].as_py(), t["g"].to_pylist()
        parts = [unpacked(h.as_buffer(), np.uint64) for h in t["h"]]
        every, firsts = np.concatenate(parts), [np.frombuffer(d.as_buffer(), np.uint8) for d in t["d"]]
        half = lambda d: len(d) // 2 if ties else len(d)
        ids = np.concatenate([from_planes(d[: half(d)], np.int64) for d in firsts])
        tie = np.concatenate([from_planes(d[half(d) :], np.uint64) for d in firsts]) if ties else np.zeros(len(ids), np.uint64)
        order = np.lexsort((tie, ids, every) if ties else (ids, every))
        h = every[order]
        later = np.empty(len(h), bool)
        later[order] = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else []
        at, rows = 0, []
        for g, p in zip(groups, parts, strict=True):
            mine = p[later[at : at + len(p)]]
            at += len(p)
            if len(mine):
                rows.append((b, g, packed(mine), None))
        return _table(rows, MESSAGE)

    return run


def _covered(x: Group, remove: np.ndarray) -> np.ndarray:
    """Which words lie in a window that also starts earlier."""
    at = np.flatnonzero(x.in_twenty)
    h = x.twenty[at]
    order = np.argsort(h, kind="stable")
    s = h[order]
    later = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else np.zeros(0, bool)
    later |= _isin(s, remove)
    edge = np.zeros(len(x.words) + 1, np.int32)
    hit = at[order[later]]
    edge[hit] += 1
    edge[hit + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _removed(ident: str, text: str, hashes: str, ties: bool, others: list[str], whole: bool, out: pa.Schema):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(t):
            return out.empty_table()
        lean()
        x = Group(t, ident, hashes, ties)
        told = [unpacked(h.as_buffer(), np.uint64) for h in replies["h"]]
        gone = _covered(x, np.sort(np.concatenate(told)) if told else np.empty(0, np.uint64))
        lost = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(x.ends - x.sizes, len(gone))) if len(x.ends) else np.empty(0, np.int64)
        lost[x.sizes == 0] = 0
        texts = t[text].cast(pa.binary())
        n_words, n_removed, kept = [], [], []
        for row in range(len(t)):
            k = x.first_of[row]
            a, b = x.ends[k] - x.sizes[k], x.ends[k]
            n_words.append(int(x.sizes[k]))
            n_removed.append(int(lost[k]))
            raw = texts[row].as_buffer()
            if whole and not lost[k]:
                kept.append(None if raw is None else raw.to_pybytes())
                continue
            words = raw.to_pybytes().split() if raw is not None else []
            if lost[k]:
                words = [w for w, g in zip(words, gone[a:b].tolist(), strict=True) if not g]
            kept.append(b" ".join(words) if whole else hashlib.sha256(b" ".join(words)).hexdigest())
        last = pa.array(kept, pa.binary()).cast(pa.string()) if whole else pa.array(kept, pa.string())
        columns = [t[c] for c in others] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last]
        return pa.Table.from_arrays(columns, schema=out)

    return run


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", groups: int | None = None, whole: bool = False) -> DataFrame:
    """docs without its text, with n_words, n_removed and, last, what is kept.

    That is kept_sha256, the digest of the kept words joined by spaces; with whole=True, kept_text: the text itself
    where nothing is removed, else the kept words joined by spaces.
    groups: how many groups, and buckets, there are, if not as many as shuffle partitions or more.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    hashes, = fresh(docs, "word_hashes")
    others = [c for c in docs.columns if c != text]
    if {"g", "n_words", "n_removed", "kept_sha256", "kept_text"} & {c.lower() for c in others}:
        clash = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
        out = remove_repeats(docs.withColumnsRenamed(clash), clash[ident], clash[text], groups, whole)
        last = out.columns[-3:]
        new = dict(zip(last, fresh(docs.select(*others), *last), strict=True))
        return out.withColumnsRenamed(new).withColumnsRenamed({v: k for k, v in clash.items()})
    each = docs.groupBy(F.col(ident).cast("long").alias("i")).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text))).alias("size"))
    most, size = each.agg(F.max("n"), F.sum("size")).first()
    ties = (most or 0) > 1
    n = groups or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // GROUP_BYTES))
    words = let(words_of(text_of(text)), lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    key = F.coalesce(F.col(ident).cast("long"), F.lit(0))
    spread = F.xxhash64(key, words) if ties else key.bitwiseXOR(F.shiftrightunsigned(key, 17)).bitwiseXOR(F.shiftrightunsigned(key, 37))
    dealt = docs.withColumn("g", F.pmod(spread, F.lit(n)).cast("int")).repartition(n, "g")
    dealt = dealt.withColumn(hashes, words)
    by_group = lambda df: df.groupBy("g")
    # Every pass takes all columns, so that all share one exchange of the documents.
    partners = by_group(dealt).applyInArrow(_anchors(n, ident, hashes, ties), MESSAGE_DDL).groupBy("b").applyInArrow(_partners, MESSAGE_DDL)
    found = by_group(dealt).cogroup(by_group(partners)).applyInArrow(_extended(n, ident, hashes, ties), MESSAGE_DDL)
    later = found.groupBy("b").applyInArrow(_later(ties), MESSAGE_DDL)
    last = "kept_text" if whole else "kept_sha256"
    shape = docs.select(*others, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").cast("string").alias(last)).schema
    for f in shape:
        f.nullable = True
    return by_group(dealt).cogroup(by_group(later)).applyInArrow(_removed(ident, text, hashes, ties, others, whole, to_arrow_schema(shape)), shape)
