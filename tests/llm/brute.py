"""Plain Python versions of what the queries return, for comparison on small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ("assign", "access", "hex")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text: str | None) -> tuple:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    count = collections.Counter(k for _, k, _ in found)
    return (count[0], count[1], count[2], sha(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))))


def parts(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base spans and then of weak candidates in what they leave."""
    from quarry.llm import secret_links as s

    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{32,}", text)]
    left = text
    # One kind after the other, as a blanked match ends what another kind could find.
    for kind, pattern, counts in ((0, ASSIGN, lambda m: len(m[2]) >= 8), (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (2, re.compile("[0-9a-f]{32,}"), lambda m: True)):
        left = pattern.sub(lambda m: "\0" * len(m[0]) if counts(m) else m[0], left)
    mixed = lambda m: bool(re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))
    weak = (
        (3, ASSIGN, lambda m: 3 <= len(m[2]) <= 7),
        (4, re.compile("AKIA[A-Z0-9]+"), lambda m: 8 <= len(m[0]) <= 15),
        (5, re.compile(s.SHORT_HEX), lambda m: len(m[0]) < 32 and mixed(m)),
        (6, re.compile(s.IDENT), lambda m: True),
        (7, re.compile(s.OPAQUE), mixed),
        (8, re.compile(s.ENDPOINT), lambda m: True),
    )
    return sorted(base) + sorted((m.start(), k, m.end()) for k, p, counts in weak for m in p.finditer(left) if counts(m))


def links(text: str | None, scope: int = 256) -> list[tuple]:
    """Each part with a complement within scope, and how far the nearest is, among all pairs."""
    secret, every, out = {0, 2, 3, 5, 7}, parts(text), []
    for p in every:
        gaps = [(0, p[0] - q[2], q[0] - p[2]) for q in every if q is not p and (p[1] in secret) != (q[1] in secret)]
        if gaps and min(map(max, gaps)) <= scope:
            out.append((*p, min(map(max, gaps))))
    return sorted(out)


def edits(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        out[i] = (n, sha(t[: n - n // 3] + u[: n // 3]))
    return out


def statistics(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    count, covered = collections.Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def repeats(docs: list[tuple[int, str | None]], n: int = 20) -> dict[int, tuple]:
    seen: set[tuple] = set()
    out = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                gone.update(range(k, k + n))
            seen.add(x)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), sha(" ".join(kept)))
    return out
