"""BPE encoding and decoding by a prefix-sharing walk over a trie of distinct words.

A text is cut at white space into chunks, a chunk into the words that the vocabulary file's
pattern gives. The distinct words of a block of text that are not yet known form a trie, held as
their sorted list; walking that list keeps, for the prefix in hand, the last token of every
shorter prefix. The last token of a prefix alone fixes its encoding: it is the one token that
ends there and may follow the encoding of what lies before it. A prefix that several words
share is therefore encoded once. What is known is kept by chunk in two generations of bounded
size, so that frequent chunks stay and memory is bounded.

The vocabulary is a tokenizers JSON file with NFC, lower case, word ends and bytes as units; its
path is a parameter. Results equal those of the tokenizers library with
add_special_tokens=False, and of its decode with skip_special_tokens=False.

Defined results: a null text is empty and has no tokens; the digests of no tokens are those of
the empty string; texts of any length are worked through in blocks; rows come and go one by one,
so repeated rows give equal results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import kept_in_worker, lean

#: White space of Unicode, which is less than what str.split() takes as such.
WHITE = "\t-\r \x85\xa0  -     　"
#: The pattern of the vocabulary file, with its white space written out.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
END = "</w>"
#: Characters of text in a block, and chunks in one generation of what is kept.
BLOCK, KEPT = 1 << 20, 300_000
#: Pairs of tokens that a worker remembers at most.
PAIRS = 1 << 19


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens and merges of a vocabulary file, and which tokens may follow each other."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a BPE vocabulary with word ends is asked for")
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.specials).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = {self.ids[a + b]: (r, self.ids[a], self.ids[b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        self.follows: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the letters of both tokens gives just these two.

        The merges at the border are undone, latest first (of equal ones the right one, as the
        left one is made first). If the two border tokens of some moment could merge before
        the merge undone last, they would have.
        """
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) >= PAIRS:  # they are made again as they are needed
                self.follows.clear()
            known = self.follows[left, right] = self._border(left, right)
        return known

    def _border(self, left: int, right: int) -> bool:
        before = len(self.rank)  # merges of a rank below this came earlier
        while True:
            if self.rank.get((left, right), before) < before:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1, b[1]

    def stands(self, token: int) -> bool:
        """Whether the letters of the token encode to the token itself."""
        known = self.alone.get(token)
        if known is None:
            m = self.made.get(token)
            known = self.alone[token] = m is None or self.stands(m[1]) and self.stands(m[2]) and self._joins(m)
        return known

    def _joins(self, m: tuple[int, int, int]) -> bool:
        """Whether the two halves meet before a merge across their border takes letters away."""
        before, left, right = m[0], m[1], m[2]
        a, b = self.made.get(left), self.made.get(right)
        if (a is None or a[0] < before) and (b is None or b[0] < before):
            return self._halves_hold(left, right, before)
        return False

    def _halves_hold(self, left: int, right: int, before: int) -> bool:
        while True:
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                before, left = a[0], a[2]
            else:
                before, right = b[0] + 1, b[1]
            if self.rank.get((left, right), before) < before:
                return False


def encode_words(words: Iterable[str], v: Vocabulary) -> Iterator[tuple[str, tuple[int, ...]]]:
    """(word, ids) for distinct words given in letters for bytes, in sorted order.

    last[j] holds the ids of the first j letters of the word in hand, starts[j] where the last
    of them starts. Just one token that ends at j fits, so the likely ones are tried first.
    """
    ids, longest, follows, may_follow, stands = v.ids, v.longest, v.follows, v.may_follow, v.stands
    last: list[tuple[int, ...]] = [()]
    starts = [0]
    held = ""
    for word in sorted(words):
        n = len(word)
        shared, most = 0, min(len(held), n - 1, len(last) - 1)
        while shared < most and held[shared] == word[shared]:
            shared += 1
        del last[shared + 1 :], starts[shared + 1 :]
        for j in range(shared + 1, n + 1):
            before = starts[j - 1]
            for k in chain(range(before, j), range(before - 1, max(0, j - longest) - 1, -1)):
                t = ids.get(word[k:j] if j < n else word[k:] + END)
                if t is None or not stands(t):
                    continue
                if not k:
                    found = (t,)
                    break
                front = last[k]
                ok = follows.get((front[-1], t))
                if may_follow(front[-1], t) if ok is None else ok:
                    found = (*front, t)
                    break
            else:
                raise ValueError(f"the vocabulary lacks a letter of {word!r}")
            if j < n:
                last.append(found)
                starts.append(k)
        yield word, found
        held = word


class Encoder:
    """Texts to ids, with what is known of chunks."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.pattern = regex.compile(WORDS)
        self.special = re.compile("(" + "|".join(map(re.escape, self.v.specials)) + ")") if self.v.specials else None
        self.white = re.compile(f"[{WHITE}]+")
        self.letters = byte_letters()
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text; special tokens are chunks of their own."""
        if self.special is not None and any(s in text for s in self.v.specials):
            parts = self.special.split(text)
            return [c for k, p in enumerate(parts) for c in ([p] if k % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # str.lower() minds where a word ends; the library doesn't
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.white.split(text) if c]
        return text.split()

    def _words(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isalpha():
            return [chunk]
        return self.pattern.findall(chunk)

    def in_letters(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return "".join([self.letters[b] for b in word.encode("utf-8")])

    def encoded(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct words."""
        by_letters = {self.in_letters(w): w for w in words}
        return {by_letters[w]: ids for w, ids in encode_words(by_letters, self.v)}

    #: What is kept for a chunk from its ids; chunks of a text are put together by joined().
    kept = staticmethod(tuple)

    @staticmethod
    def joined(parts: Iterable[tuple[int, ...]]) -> list[int]:
        return list(chain.from_iterable(parts))

    def learn(self, chunks: set[str]) -> None:
        """Make the ids of these chunks known; no others need stay so."""
        young, old = self.young, self.old
        new = chunks.difference(young)
        if not new:
            return
        again = {c: old[c] for c in new if c in old}
        new.difference_update(again)
        special = self.v.specials
        by_chunk = {c: self._words(c) for c in new if c not in special}
        words = {w for ws in by_chunk.values() for w in ws}
        seen = {w: young[w] if w in young else old[w] for w in words if w in young or w in old}
        ids = {w: self.kept(x) for w, x in self.encoded(words.difference(seen)).items()} | seen
        if len(young) > KEPT:
            self.old = young
            self.young = {c: young[c] for c in chunks if c in young}
        young = self.young
        young.update(again)
        for c in new:
            ws = by_chunk.get(c)
            if ws is None:
                young[c] = self.kept((special[c],))
            else:
                young[c] = ids[ws[0]] if len(ws) == 1 else self.kept(self.joined([ids[w] for w in ws]))
        young.update(ids)

    def blocks(self, texts: Iterable[str]) -> Iterator[list[tuple[int, list]]]:
        """For each block the places of texts and their ids, or part of them; places ascend."""
        held: list[tuple[int, list[str]]] = []
        size = 0

        def known() -> list[tuple[int, list]]:
            self.learn(set(chain.from_iterable(c for _, c in held)))
            get = self.young.__getitem__
            return [(k, self.joined(map(get, c))) for k, c in held]

        for k, text in enumerate(texts):
            for part in self.parts(text):
                held.append((k, self.chunks(part)))
                size += len(part)
                if size >= BLOCK:
                    yield known()
                    held, size = [], 0
        if held:
            yield known()

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts, cut at spaces."""
        at = 0
        while len(text) - at > 2 * BLOCK:
            end = text.find(" ", at + BLOCK)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def whole(self, texts: Iterable[str]) -> Iterator[tuple[int, list]]:
        """The place and all ids of each text."""
        place, parts = -1, []
        for block in self.blocks(texts):
            for k, ids in block:
                if k != place and place >= 0:
                    yield place, parts[0] if len(parts) == 1 else self.joined(parts)
                if k != place:
                    place, parts = k, []
                parts.append(ids)
        if place >= 0:
            yield place, parts[0] if len(parts) == 1 else self.joined(parts)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in each Python worker."""
    return Encoder(path)


kept_in_worker.append(encoder.cache_clear)


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of ids as the library gives it for a vocabulary without a decoder: tokens and spaces."""
    return " ".join(map(v.tokens.__getitem__, ids))


def digests(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its id, n_tokens, and digests of its ids and of the decoded text."""
    kind = docs.schema[ident].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(keep=True)
        e = encoder(path)
        tokens = e.v.tokens
        numbers = {i: str(i) for i in tokens}
        for batch in batches:
            texts = batch.column(1)
            n, a, b = [0] * len(texts), [None] * len(texts), [None] * len(texts)
            for block in e.blocks((t.as_py() or "") for t in texts):
                for k, ids in block:
                    if a[k] is None:
                        a[k], b[k] = hashlib.sha256(), hashlib.sha256()
                    if not ids:
                        continue
                    gap = " " if n[k] else ""
                    a[k].update((gap + " ".join(map(numbers.__getitem__, ids))).encode())
                    b[k].update((gap + " ".join(map(tokens.__getitem__, ids))).encode())
                    n[k] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in a], pa.string()), pa.array([x.hexdigest() for x in b], pa.string())],
                [ident, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(ident, text).mapInArrow(work, f"`{ident}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
