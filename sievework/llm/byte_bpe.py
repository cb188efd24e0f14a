"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .pieces import PieceCoder, spread

NEVER = np.iinfo(np.int32).max
PAD = -1
#: Rows longer than this are merged alone.
WIDE = 256
MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id that it merges into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NEVER, np.int32)
        keys, self.probes = self._key(left, right), 0
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slots[todo]] == -1]
            self.keys[slots[free]] = keys[free]  # of several, the last one wins the slot
            won = free[self.keys[slots[free]] == keys[free]]
            self.values[slots[won]] = merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.mask

    @staticmethod
    def _key(left, right):
        return left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF

    def _slot(self, keys):
        return (keys.view(np.uint64) * MIX >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NEVER where a pair does not merge."""
        keys = self._key(left, right).ravel()
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], NEVER)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & self.mask
            here = self.keys[slots[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
        return found.reshape(left.shape)


class ByteBpe:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        triples = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        self.pairs = PairTable(*np.array(triples, np.int32).reshape(-1, 3).T)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.array([len(token) for token in self.tokens])
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.coded = PieceCoder(self.encode_pieces)

    def _matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        """Merges all rows, each of at most width bytes, one pair a row and round."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.full((len(rows), width), PAD, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        out: list[bytes] = [b""] * len(rows)
        where = np.arange(len(rows))
        while len(where):
            best = ranks.argmin(1)  # the leftmost of the least
            least = ranks[np.arange(len(ranks)), best]
            done = least == NEVER
            if done.any():
                raw, wide = ids[done].astype("<i4").tobytes(), ids.shape[1] * 4
                ends = (ids[done] != PAD).sum(1) * 4
                for n, (k, end) in enumerate(zip(where[done].tolist(), ends.tolist(), strict=True)):
                    out[k] = raw[n * wide : n * wide + end]
                going = ~done
                where, ids, ranks, best, least = (x[going] for x in (where, ids, ranks, best, least))
                if not len(where):
                    break
            used = int((ids != PAD).sum(1).max())
            ids, ranks = ids[:, :used], ranks[:, : used - 1]
            row, column = np.arange(len(ids)), np.arange(used)
            ids[row, best] = least
            source = column + (column > best[:, None])
            source[source == used] = used - 1
            last = ids[:, -1].copy()
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = np.where(best == used - 1, last, PAD)
            column = np.arange(used - 1)
            source = column + (column > best[:, None])
            source[source == used - 1] = used - 2
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = NEVER
            for at in (best - 1, best):
                inside = np.flatnonzero((at >= 0) & (at + 1 < used))
                spot = at[inside]
                ranks[inside, spot] = self.pairs(ids[inside, spot], ids[inside, spot + 1])
        return out

    def _alone(self, row: bytes) -> bytes:
        """A wide row. All its pairs of the least rank merge in one round, unless a merge makes a
        pair of a lower rank, which has to go before the next one of this rank."""
        ids = self.of_byte[np.frombuffer(row, np.uint8)]
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ids) > 1 and (least := ranks.min()) != NEVER:
            at = np.flatnonzero(ranks == least)
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            for spots in (at, at[:1]):
                new = ids.copy()
                new[spots] = least
                kept = np.ones(len(ids), bool)
                kept[spots + 1] = False
                new = new[kept]
                spots_new = spots - np.arange(len(spots))
                new_ranks = self.pairs(new[:-1], new[1:])
                left = spots_new[spots_new > 0] - 1
                right = spots[spots + 2 < len(ids)] + 2
                early = self.pairs(np.full(len(right), least, np.int32), ids[right])
                if len(spots) == 1 or (
                    new_ranks[left].min(initial=NEVER) > least
                    and early.min(initial=NEVER) > least
                    and new_ranks[spots_new[spots_new < len(new_ranks)]].min(initial=NEVER) > least
                ):
                    break
            ids, ranks = new, new_ranks
        return ids.astype("<u4").tobytes()

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of each piece, little-endian unsigned 32-bit."""
        out: list[bytes] = [b""] * len(texts)
        by_width: dict[int, list[tuple[int, bytes]]] = {}
        for k, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(raw) > WIDE:
                out[k] = self._alone(raw)
            else:
                width = len(raw) if len(raw) <= 8 else -(-len(raw) // 8) * 8
                by_width.setdefault(width, []).append((k, raw))
        for width, rows in by_width.items():
            step = max(1, 131_072 // width)
            for low in range(0, len(rows), step):
                some = rows[low : low + step]
                for (k, _), ids in zip(some, self._matrix([r for _, r in some], width), strict=True):
                    out[k] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[spread(self.sizes[ids], self.offsets[ids])].tobytes()


@functools.cache
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True
) -> DataFrame:
    """For each row: id, ids (binary, little-endian unsigned 32-bit), decoded (binary), n_tokens,
    ids_sha256, decoded_sha256. full=False leaves the two binaries out.

    The ids are those of the merge ranks with each piece encoded separately and no special tokens.
    Null and empty texts give no ids. Rows are encoded one by one, so repeated rows give the same
    result and an empty table an empty one. Only the two columns are read. A worker holds one
    Arrow batch and a cache of bounded size; the ranks' file is read by each worker from its path.
    """
    fields = [pa.field("id", pa.int64())]
    fields += [pa.field("ids", pa.binary()), pa.field("decoded", pa.binary())] * full
    fields += [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string())]
    schema = pa.schema([*fields, pa.field("decoded_sha256", pa.string())])

    def run(batches):
        bpe = loaded(ranks_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                columns = {name: [] for name in schema.names}
                columns["id"] = some.column(0)
                for found in bpe.coded(some.column(1).to_pylist()):
                    ids, decoded = found.tobytes(), bpe.decode(found)
                    if full:
                        columns["ids"].append(ids)
                        columns["decoded"].append(decoded)
                    columns["n_tokens"].append(len(ids) // 4)
                    columns["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    columns["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                yield pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)).withColumnRenamed("id", id_col)
