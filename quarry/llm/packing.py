"""Bounded-space online packing of documents into sequences of a fixed number of tokens.

Each partition keeps at most ``WINDOWS`` open windows. Whole windows of a long document go out
at once; what remains is placed best-fit, in the open window that it leaves least room in. When
none fits, the fullest is filled up with the start of the document and emitted, and the rest is
placed again. Windows still open at the end of a partition are merged with those of a few
neighbouring partitions, longest piece first, again best-fit; only these can hold padding.

Ids come from a tokenizers file at a path, through the tokenizers library, for each distinct
chunk of text once; a document ends with id 2.

Defined results: a null or empty text is the end id alone; every row of the input is a document
of its own, repeated rows too; texts of any length are cut as needed; other columns of the input
are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import kept_in_worker, lean, stored
from quarry.llm.trie_bpe import Encoder

CAPACITY = 4096
WINDOWS = 8
END_ID = 2
#: Partitions whose leftovers are merged in one task.
NEIGHBOURS = 8


class ByteEncoder(Encoder):
    """Texts to ids as little-endian unsigned 32-bit numbers, by the library."""

    kept = staticmethod(lambda ids: ids if isinstance(ids, bytes) else np.asarray(ids, "<u4").tobytes())
    joined = staticmethod(b"".join)

    def __init__(self, path: str) -> None:
        super().__init__(path)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()

    def encoded(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """All words in one call: between spaces each stays a word of its own."""
        listed = list(words)
        if not listed:
            return {}
        found = self.library.encode(" ".join(listed), add_special_tokens=False)
        ids, of = np.array(found.ids, "<u4"), np.array(found.word_ids)
        ends = np.searchsorted(of, np.arange(len(listed)), "right")
        if len(of) == 0 or of[-1] != len(listed) - 1 or (np.diff(ends, prepend=0) == 0).any():
            return {w: tuple(self.library.encode(w, add_special_tokens=False).ids) for w in listed}
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return {w: data[at[k] : at[k + 1]] for k, w in enumerate(listed)}


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


kept_in_worker.append(byte_encoder.cache_clear)


PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """The open windows of one partition."""

    def __init__(self, first: int, capacity: int = CAPACITY, windows: int = WINDOWS) -> None:
        self.next, self.capacity, self.windows = first, capacity, windows
        self.open: list[tuple[int, int]] = []  # (room left, sequence), ascending

    def place(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a document of n ids."""
        at = 0
        while n - at >= self.capacity:
            yield at, self.capacity, self._new(), 0
            at += self.capacity
        while at < n:
            left = n - at
            k = bisect_left(self.open, (left, -1))
            if k == len(self.open) and len(self.open) < self.windows:
                self.open.append((self.capacity, self._new()))
            elif k == len(self.open):
                k = 0  # none fits: the fullest is filled up and emitted
            room, sequence = self.open.pop(k)
            size = min(room, left)
            yield at, size, sequence, self.capacity - room
            at += size
            if size < room:
                insort(self.open, (room - size, sequence))

    def _new(self) -> int:
        self.next += 1
        return self.next - 1


def merge(pieces: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """For pieces (length, key) in the order given: (window, offset), best-fit, longest first."""
    open_: list[tuple[int, int]] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(pieces)
    made = 0
    for k in sorted(range(len(pieces)), key=lambda k: (-pieces[k][0], pieces[k][1], k)):
        n = pieces[k][0]
        at = bisect_left(open_, (n, -1))
        if at == len(open_):
            room, window, made = capacity, made, made + 1
        else:
            room, window = open_.pop(at)
        out[k] = (window, capacity - room)
        if room > n:
            insort(open_, (room - n, window))
    return out


def pack(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """One row for each piece: the id and ``PIECE``."""
    kind = docs.schema[ident].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in PIECE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(keep=True)
        e = byte_encoder(path)
        part = TaskContext.get().partitionId()
        packer = Packer(part << 32, capacity, windows)
        end = np.array([END_ID], "<u4").tobytes()
        held: dict[int, list[tuple]] = {}  # pieces of open windows

        def rows(found: list[tuple], open_: bool) -> pa.RecordBatch:
            ids, rest = pa.array([f[0] for f in found], ident_type), list(zip(*[f[1:] for f in found], strict=True))
            return pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, pa.int64()) for c in rest], pa.array([part] * len(found), pa.int64()), pa.array([open_] * len(found))], [ident, *PIECE, "part", "open"]
            )

        ident_type = None
        for batch in batches:
            ident_type = batch.schema.field(0).type
            keys, done = batch.column(0), []
            for k, ids in e.whole((t.as_py() or "") for t in batch.column(1)):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                key = keys[k].as_py()
                for start, length, sequence, offset in packer.place(n):
                    piece = (key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, sequence, offset)
                    if offset + length == capacity:
                        done += [*held.pop(sequence, ()), piece]
                    else:
                        held.setdefault(sequence, []).append(piece)
            if done:
                yield rows(done, False)
        left = [p for ps in held.values() for p in ps]
        if left:
            yield rows(left, True)

    found = stored(docs.select(ident, text).mapInArrow(work, f"`{ident}` {kind}, {columns}, part long, open boolean"), "pieces")

    def together(t: pa.Table) -> pa.Table:
        """The leftovers of neighbouring partitions in new windows; ids follow the first of these partitions."""
        order = [("sequence_id", "ascending"), ("offset", "ascending")]
        t = t.sort_by(order)
        first = (t["part"][0].as_py() // NEIGHBOURS * NEIGHBOURS << 32) + (1 << 31)
        spots = merge(list(zip(t["length"].to_pylist(), range(len(t)), strict=True)), capacity)
        t = t.set_column(t.schema.get_field_index("sequence_id"), "sequence_id", pa.array([first + w for w, _ in spots], pa.int64()))
        t = t.set_column(t.schema.get_field_index("offset"), "offset", pa.array([o for _, o in spots], pa.int64()))
        return t.select([ident, *PIECE])

    whole = found.where("not open").select(ident, *PIECE)
    rest = found.where("open").groupBy(F.floor(F.col("part") / NEIGHBOURS)).applyInArrow(together, f"`{ident}` {kind}, {columns}")
    return whole.unionByName(rest)
