"""Packing of tokenised documents into training windows by minimum bin slack.

Documents are cut into whole windows; what remains of each waits in a bounded store. A window is
filled by the longest waiting remainder and, of the others, the multiset of lengths that comes
closest to the space left, found by a subset-sum over bitsets. A combination is used again as often
as the counts allow. Everything happens in the one pass that tokenises, without a shuffle.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .pieces import PieceCoder

#: The bytes that stand for themselves in a byte-level vocabulary file.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: Remainders that a task holds before it packs half of them.
STORE = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closest(lengths: list[int], counts: Callable[[int], int], space: int) -> dict[int, int]:
    """How many of each length fill the space as closely as any multiset of them can.

    lengths ascend; counts(length) is how many there are. reach has a bit for each sum that can be
    made; what it was before each step leads back from the best sum to the counts.
    """
    full, mask = 1 << space, (2 << space) - 1
    reach, steps = 1, []
    for length in reversed(lengths[: bisect_right(lengths, space)]):
        left, copies = min(counts(length), space // length), 1
        while left > 0:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + copies
            at -= length * copies
    return used


class Packer:
    """Takes documents' ids and gives rows (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int, store: int = STORE):
        self.capacity, self.sequence, self.store = capacity, first_sequence, store
        self.waiting: dict[int, list[tuple]] = {}  # by length: (doc_id, start, ids, doc_tokens)
        self.lengths: list[int] = []  # the keys of waiting, ascending
        self.held = 0

    def _put(self, item: tuple) -> None:
        length = len(item[2])
        if length not in self.waiting:
            self.waiting[length] = []
            insort(self.lengths, length)
        self.waiting[length].append(item)
        self.held += 1

    def _take(self, length: int) -> tuple:
        items = self.waiting[length]
        item = items.pop()
        self.held -= 1
        if not items:
            del self.waiting[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return item

    def _row(self, item: tuple, sequence: int, offset: int) -> tuple:
        doc_id, start, ids, total = item
        return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset

    def add(self, doc_id, ids: np.ndarray):
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield self._row((doc_id, start, ids[start : start + self.capacity], len(ids)), self.sequence, 0)
            self.sequence += 1
        if whole < len(ids):
            self._put((doc_id, whole, ids[whole:].copy(), len(ids)))
        if self.held >= self.store:
            yield from self._pack(self.store // 2)

    def _pack(self, leave: int):
        while self.held > leave:
            longest = self.lengths[-1]
            others = lambda k: len(self.waiting[k]) - (k == longest)
            used = closest(self.lengths, others, self.capacity - longest)
            used[longest] = used.get(longest, 0) + 1
            slack = self.capacity - sum(k * n for k, n in used.items())
            times = 1 if slack else min(len(self.waiting[k]) // n for k, n in used.items())
            for _ in range(times):
                items = [self._take(k) for k in sorted(used, reverse=True) for _ in range(used[k])]
                if slack and self.held:  # every waiting remainder is longer than the slack
                    doc_id, start, ids, total = self._take(self.lengths[0])
                    items.append((doc_id, start, ids[:slack], total))
                    self._put((doc_id, start + slack, ids[slack:], total))
                elif slack:
                    yield from self._last(items)
                    return
                yield from self._window(items)

    def _window(self, items: list[tuple]):
        offset = 0
        for item in items:
            yield self._row(item, self.sequence, offset)
            offset += len(item[2])
        self.sequence += 1

    def _last(self, items: list[tuple]):
        """What is left fills sequences whose lengths are powers of two, which need no padding."""
        left = sum(len(x[2]) for x in items)
        items = items[::-1]
        while left:
            room = 1 << left.bit_length() - 1
            left -= room
            window = []
            while room:
                doc_id, start, ids, total = items.pop()
                window.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    items.append((doc_id, start + room, ids[room:], total))
                room -= len(window[-1][2])
            yield from self._window(window)

    def finish(self):
        yield from self._pack(0)


@functools.cache
def _coder(path: str) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """The tokenizer's ids of texts. Texts are cut at the file's added tokens, each of which is one id,
    the longest where several begin; what is between them is coded apart. The byte-level vocabulary is read as merge ranks, which is
    the same thing where ids ascend with the merges (checked), and coded by a faster library."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, added = whole["model"], {x["content"]: x["id"] for x in whole.get("added_tokens") or []}
    if any(x.get(k) for x in whole.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token of this vocabulary takes in what is around it")
    sign = {chr(b): b for b in PRINTABLE}
    sign |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
    raw = {bytes(map(sign.__getitem__, x)): k for x, k in model["vocab"].items() if set(x) <= sign.keys()}
    made = ["".join(x if isinstance(x, list) else x.split(" ", 1)) for x in model["merges"]]
    if [model["vocab"][x] for x in made] != list(range(256, 256 + len(made))):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    ranks = {x: k for x, k in raw.items() if k < 256 + len(made)}
    piece = tiktoken.Encoding(path, pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    coder = PieceCoder(lambda found: [array("I", piece(x.encode())).tobytes() for x in found])
    if not added:
        return coder
    cuts = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")

    def code(texts: list[str]) -> Iterator[np.ndarray]:
        parts = [cuts.split(x) for x in texts]
        plain = coder([x for own in parts for x in own[::2]])
        for own in parts:
            ids = [next(plain)]
            for token in own[1::2]:
                ids += [np.array([added[token]], "<u4"), next(plain)]
            yield np.concatenate(ids) if len(ids) > 1 else ids[0]

    return code


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's (none added around a text; one id for each of the file's added
    tokens that a text holds) and end_id; a null or empty text has
    end_id alone. Each id lies in exactly one piece; each sequence is filled from 0 without a gap
    and holds capacity ids or a power of two of them. A repeated row is packed each time, a null id
    stays null, an empty table gives no rows, and other columns are not read. Sequence numbers hold
    the task's number in their upper bits, so a task that runs again gives the same rows.
    """

    def run(batches):
        coder = _coder(tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch_of(rows):
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=names)

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some, rows = batch.slice(low, 512), []
                for doc_id, ids in zip(some.column(0).to_pylist(), coder(some.column(1).to_pylist()), strict=True):
                    rows += packer.add(doc_id, np.append(ids, np.uint32(end_id)).astype(np.uint32))
                if rows:
                    yield batch_of(rows)
        if rows := list(packer.finish()):
            yield batch_of(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
