"""Splits texts into the pieces inside which byte-level BPE merges, on arrays of code points.

The result is that of the usual pattern: contractions, then an optional space with letters, with
numbers or with other signs, then white space, whose last character goes with what follows.
"""

from __future__ import annotations

import functools

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
#: The contractions of the pattern.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@functools.cache
def kinds() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, everything):
            table[found.start() : found.end()] = kind
    return table


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts(text: str, points: np.ndarray) -> np.ndarray:
    """The positions at which the pieces of a text start; none for an empty text."""
    if not text:
        return np.empty(0, np.int64)
    kind = kinds()[points]
    begins = np.ones(len(points), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    blank = kind == SPACE
    lasts = np.flatnonzero(blank[:-1] & ~blank[1:])
    begins[lasts] = True
    begins[lasts[points[lasts] == 0x20] + 1] = False
    quotes = np.flatnonzero((points[:-1] == 0x27) & begins[:-1])
    for at in quotes.tolist():
        if text[at + 1] in SHORT_ENDINGS:
            end = at + 2
        elif text[at + 1 : at + 3] in LONG_ENDINGS:
            end = at + 3
        else:
            continue
        begins[at + 1] = False
        if end < len(begins):
            begins[end] = True
    return np.flatnonzero(begins)


def spread(lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The indices offsets[k], offsets[k] + 1, ... of lengths[k] each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - ends + lengths, lengths)


class PieceCoder:
    """Codes texts piece by piece. Equal pieces of many texts are found by a rolling 64-bit hash and
    their lengths, and coded once; encode(list of pieces) gives their ids as little-endian unsigned
    32-bit integers. Bounds of the memory: characters in work at once and pieces kept.

    Long pieces, of which such a hash has known collisions, are also compared sign by sign.
    """

    FACTOR, SURE = 0x9E3779B97F4A7C15, 64

    def __init__(self, encode, chars: int = 2_000_000, kept: int = 500_000):
        self.encode, self.chars, self.kept = encode, chars, kept
        self.cache: dict[str, bytes] = {}
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, self.chars)
            for name, factor in (("powers", self.FACTOR), ("inverses", pow(self.FACTOR, -1, 1 << 64))):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def _known(self, found: list[str]) -> list[bytes]:
        codes = list(map(self.cache.get, found))
        new = [x for x, code in zip(found, codes, strict=True) if code is None]
        if not new:
            return codes
        made = self.encode(new)
        if len(self.cache) + len(new) > self.kept:
            self.cache.clear()
        self.cache.update(zip(new, made, strict=True))
        rest = iter(made)
        return [next(rest) if code is None else code for code in codes]

    def _ids(self, text: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """The ids of the pieces, and how many each has."""
        self._grow(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * self.powers[: len(points)], out=sums[1:])
        keys = (sums[end] - sums[begin]) * self.inverses[begin]
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        lengths = end - begin
        like = first[of]
        far = np.flatnonzero(lengths > self.SURE)
        if (lengths != lengths[like]).any() or (
            points[spread(lengths[far], begin[far])] != points[spread(lengths[far], begin[like[far]])]
        ).any():
            first = of = np.arange(len(begin))
        found = [text[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        codes = self._known(found)
        counts = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        flat = np.frombuffer(b"".join(codes), "<u4")
        each = counts[of]
        return flat[spread(each, (np.cumsum(counts) - counts)[of])], each

    def long(self, text: str) -> np.ndarray:
        points = points_of(text)
        begin = starts(text, points)
        end = np.append(begin[1:], len(points))
        done, low = [np.empty(0, "<u4")], 0
        while low < len(begin):
            high = max(low + 1, int(np.searchsorted(end, begin[low] + self.chars)))
            at, to = begin[low], end[high - 1]
            done.append(self._ids(text[at:to], points[at:to], begin[low:high] - at, end[low:high] - at)[0])
            low = high
        return np.concatenate(done)

    def __call__(self, texts: list[str]):
        """The ids of each text, in order."""
        low = 0
        while low < len(texts):
            high, chars = low, 0
            while high < len(texts) and (high == low or chars + len(texts[high]) <= self.chars):
                chars += len(texts[high])
                high += 1
            if chars > self.chars:
                yield self.long(texts[low])
            elif not chars:
                yield from [np.empty(0, "<u4")] * (high - low)
            else:
                points = [points_of(x) for x in texts[low:high]]
                begins = [starts(x, p) for x, p in zip(texts[low:high], points, strict=True)]
                sizes = np.array([len(p) for p in points])
                offsets = np.cumsum(sizes) - sizes
                begin = np.concatenate([b + o for b, o in zip(begins, offsets, strict=True)])
                text, end = "".join(texts[low:high]), np.append(begin[1:], sizes.sum())
                ids, counts = self._ids(text, np.concatenate(points), begin, end)
                ends = np.append(0, np.cumsum(counts))[np.cumsum([len(b) for b in begins])]
                yield from np.split(ids, ends[:-1])
            low = high
