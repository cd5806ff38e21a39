"""Byte-level pre-tokens of many texts at once, as numpy arrays, and a bounded cache from pre-token to result.

The split follows the byte-level pattern  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[other]+|white(?!\\S)|white  with L letters and N
numbers. Texts are laid end to end as code points with a mark between them; every boundary is found by comparing
neighbouring character classes, so no text is scanned by Python. Pre-tokens are looked up by a 64-bit hash
taken from prefix sums and then compared character by character, so two of equal hash are never confused.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import regex
from tokenizers import pre_tokenizers

END, LETTER, NUMBER, OTHER, SPACE, SPECIAL = 0, 1, 2, 3, 4, 5
#: Code points beyond Unicode that stand for the end of a text and for a special token.
END_CP, SPECIAL_CP = 0x110000, 0x110001
#: Unicode's White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters handled together, and cache slots. Both bound memory, not results.
SLICE = 1 << 19
SLOTS_LOG2 = 20
#: Characters that a cache holds before it starts anew, and of the longest word it holds.
POOL_CHARS, LONGEST = 1 << 23, 1024


@cache
def classes() -> np.ndarray:
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    t = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            t[m.start() : m.end()] = kind
    # Characters that the Unicode versions of Python and regex class differently are asked of the tokenizers library.
    kinds = {"L": LETTER, "N": NUMBER}
    own = np.fromiter((kinds.get(unicodedata.category(c)[0], OTHER) for c in every), np.uint8, 0x110000)
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero(own != t).tolist():
        ends = [e for _, (_, e) in split(f"a{chr(c)}1")]
        t[c] = LETTER if ends == [2, 3] else NUMBER if ends == [1, 3] else OTHER
    t[WHITE] = SPACE
    return np.append(t, np.array([END, SPECIAL], np.uint8))


def lay(texts: list[str], special: str | None) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts in one string, its code points with END_CP behind each text, and the offset of each; special strings become one SPECIAL_CP."""
    marks: list[int] = []
    at, starts = 0, np.empty(len(texts), np.int64)
    parts = []
    for k, t in enumerate(texts):
        starts[k] = at
        if special and special in t:
            pieces = t.split(special)
            p = at
            for x in pieces[:-1]:
                p += len(x) + 1
                marks.append(p - 1)
            t = "\0".join(pieces)
        parts.append(t)
        at += len(t) + 1
    parts.append("")
    laid = "\0".join(parts)
    cp = np.frombuffer(laid.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    cp[np.append(starts[1:], at) - 1 if len(texts) else []] = END_CP
    cp[marks] = SPECIAL_CP
    return laid, cp, starts


def boundaries(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each pre-token, and whether it is a special token."""
    n = len(cp)
    cp = np.concatenate([cp, np.full(3, END_CP, np.uint32)])
    cls = classes()[cp]
    start = np.empty(len(cp), bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    mark = (cls == END) | (cls == SPECIAL)
    start |= mark
    start[1:] |= mark[:-1]
    # The last of a run of white space before something else stands alone, and a blank there joins what follows.
    last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] >= LETTER) & (cls[1:] <= OTHER))
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    quote = np.flatnonzero(cp[:n] == 0x27)
    quote = quote[start[quote] & (cls[quote + 1] == LETTER)]
    a, b = cp[quote + 1], cp[quote + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for hit, k in ((one, 1), (two, 2)):
        at = quote[hit]
        start[at + 1] = False
        start[at + 1 + k] = True
    begin = np.flatnonzero(start[: n + 1])
    end, begin = begin[1:], begin[:-1]
    real = cls[begin] != END
    begin, end = begin[real], end[real]
    return begin, end, cls[begin] == SPECIAL


def hashes(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of cp[begin:end] for ascending, disjoint ranges, in slices of about SLICE characters.

    The sum over the characters of a mix of character and place, which no order of letters can balance as it
    can in a polynomial. Equal hashes only propose equality; see same().
    """
    out = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        j = max(k + 1, int(np.searchsorted(end, begin[k] + SLICE, "right")))
        lo, hi = int(begin[k]), int(end[j - 1])
        b, e = begin[k:j] - lo, end[k:j] - lo
        place = np.arange(hi - lo)
        place -= np.repeat(b, np.diff(np.append(b, hi - lo)))
        x = place.view(np.uint64)
        x *= np.uint64(0x9E3779B97F4A7C15)
        y = cp[lo:hi].astype(np.uint64)
        y += np.uint64(0x1F123BB5)
        y *= np.uint64(0xD6E8FEB86659FD93)
        x ^= y
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        s = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(x, out=s[1:])
        h = s[e] - s[b]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        out[k:j] = h
        k = j
    out[out == 0] = 1
    return out


def same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a[at:at + n] equals b[bt:bt + n], for each of many ranges of at least one character, in slices of about SLICE."""
    out, total, k = np.empty(len(n), bool), np.cumsum(n), 0
    while k < len(n):
        done = int(total[k - 1]) if k else 0
        j = max(k + 1, int(np.searchsorted(total, done + SLICE, "right")))
        size = n[k:j]
        head = total[k:j] - size - done
        kind = np.int32 if max(len(a), len(b)) < 1 << 31 else np.int64
        i = np.arange(int(total[j - 1]) - done, dtype=kind)
        x = np.repeat((at[k:j] - head).astype(kind), size)
        x += i
        y = np.repeat((bt[k:j] - head).astype(kind), size)
        y += i
        equal = a.take(x) == b.take(y)
        out[k:j] = np.logical_and.reduceat(equal, head)
        k = j
    return out


def exact_ids(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the words data[begin:end], equal exactly where all characters are."""
    out, n, todo, top = np.empty(len(begin), np.int64), end - begin, np.arange(len(begin)), 0
    h = hashes(data, begin, end)
    while len(todo):
        _, first, which = np.unique(h[todo], return_index=True, return_inverse=True)
        head = todo[first][which]
        ok = n[todo] == n[head]
        ok[ok] = same(data, begin[todo[ok]], data, begin[head[ok]], n[todo[ok]])
        out[todo[ok]] = top + which[ok]
        top += len(first)
        todo = todo[~ok]
    return out


class Cache:
    """From a word to a number that `resolve` gives. Direct-mapped by hash; a hit counts only if all characters agree."""

    def __init__(self, resolve: Callable[[list[str]], np.ndarray]):
        self.resolve = resolve
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << SLOTS_LOG2, np.uint64)
        self.val = np.zeros(1 << SLOTS_LOG2, np.int64)
        self.at, self.size = (np.zeros(1 << SLOTS_LOG2, np.int32) for _ in range(2))
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _keep(self, slot: np.ndarray, h: np.ndarray, val: np.ndarray, cp: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
        short = n <= LONGEST
        if not short.all():
            slot, h, val, begin, n = (x[short] for x in (slot, h, val, begin, n))
        total = int(n.sum())
        if self.used + total > POOL_CHARS:
            self.clear()
        while len(self.pool) < self.used + total:
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint32))
        head = np.cumsum(n) - n
        self.pool[self.used : self.used + total] = cp[np.arange(total) + np.repeat(begin - head, n)]
        # of two words in one slot the later wins everywhere alike
        self.key[slot], self.val[slot], self.at[slot], self.size[slot] = h, val, head + self.used, n
        self.used += total

    def get(self, text: str, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words text[begin:end], whose code points are cp."""
        h, n = hashes(cp, begin, end), end - begin
        slot = (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        out = self.val[slot]
        hit = (self.key[slot] == h) & (self.size[slot] == n)
        hit[hit] = same(cp, begin[hit], self.pool, self.at[slot[hit]].astype(np.int64), n[hit])
        todo = np.flatnonzero(~hit)
        while len(todo):
            new, first, which = np.unique(h[todo], return_index=True, return_inverse=True)
            at = todo[first]
            head = at[which]
            ok = n[todo] == n[head]
            ok[ok] = same(cp, begin[todo[ok]], cp, begin[head[ok]], n[todo[ok]])
            found = self.resolve([text[i:j] for i, j in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            out[todo[ok]] = found[which[ok]]
            self._keep(slot[at], new, found, cp, begin[at], n[at])
            todo = todo[~ok]  # other words of equal hash
        return out


def in_slices(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) with about limit characters each; null counts as empty."""
    at, part, size = 0, [], 0
    for k, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1]) + 1
        if size >= limit:
            yield at, part
            at, part, size = k + 1, [], 0
    if part:
        yield at, part
