"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes and a sign for the word's end. When a word cannot go on at a
node, a failure link leads to where matching resumes after the longest pieces of what was read are
taken off, and a number says how many pieces those are. Both are worked out beforehand, so a word is
read once, nothing is looked at twice and no piece is ever built.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import NEVER, PairTable
from .common import text_of
from .packing import PRINTABLE

END, NOWHERE = 256, -1
#: Fixed value: the suffix that marks a piece at a word's end in the vocabulary file.
SUFFIX = "</w>"
#: What a word of white-space-separated text is cut into before matching.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
KEPT_WORDS = 400_000
#: Bytes up to which words go through the automaton side by side.
LONGEST = 512


class LongestMatch:
    def __init__(self, pieces: list[tuple[int, ...]]):
        """pieces: the vocabulary as byte values, END at last for pieces that end a word."""
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for sign in piece:
                if sign not in children[node]:
                    children[node][sign] = len(children)
                    children.append({})
                    whole.append(False)
                node = children[node][sign]
            whole[node] = node != 0
        fail, popped = [NOWHERE] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for sign, node in children[above].items():
                queue.append(node)
                if whole[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                back, count = fail[above], popped[above]
                while back != NOWHERE and sign not in children[back]:
                    count += popped[back]
                    back = fail[back]
                if back != NOWHERE:
                    fail[node], popped[node] = children[back][sign], count
        edges = [(a, sign, b) for a, own in enumerate(children) for sign, b in own.items()]
        self.next = PairTable(*np.array(edges, np.int32).reshape(-1, 3).T)
        self.fail, self.popped = np.array(fail), np.array(popped)
        self.plain = children, fail, popped

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many pieces each word has; one, if it cannot be matched."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], LONGEST, "right"))
        for low in range(0, short, 8192):  # words of like length go together
            some = order[low : min(low + 8192, short)]
            out[some] = self._rows([words[k] for k in some.tolist()], sizes[some])
        for k in order[short:].tolist():
            out[k] = self._one(words[k])
        return out

    def _one(self, word: bytes) -> int:
        """The same for a single word, sign by sign: a long word has no others to go with."""
        children, fail, popped = self.plain
        state = count = 0
        for sign in (*word, END):
            while sign not in children[state]:
                if fail[state] == NOWHERE:
                    return 1
                count += popped[state]
                state = fail[state]
            state = children[state][sign]
        while state:
            if fail[state] == NOWHERE:
                return 1
            count += popped[state]
            state = fail[state]
        return count

    def _rows(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        raw = np.append(np.frombuffer(b"".join(words), np.uint8), 0).astype(np.int32)
        offsets = np.cumsum(sizes) - sizes
        state, count, lost = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        for column in range(int(sizes.max(initial=-1)) + 1):
            rows = np.flatnonzero((sizes >= column) & ~lost)
            inside = column < sizes[rows]
            sign = np.where(inside, raw[np.where(inside, offsets[rows] + column, 0)], END).astype(np.int32)
            while len(rows):
                to = self.next(state[rows], sign)
                go = to != NEVER
                state[rows[go]] = to[go]
                rows, sign = rows[~go], sign[~go]
                rows, sign = self._back(state, count, lost, rows, sign)
        rows = np.flatnonzero((state != 0) & ~lost)
        while len(rows):
            rows, _ = self._back(state, count, lost, rows, rows)
            rows = rows[state[rows] != 0]
        return np.where(lost, 1, count)

    def _back(self, state, count, lost, rows, sign):
        """Follows the failure links of these rows; rows without one are lost."""
        at = state[rows]
        dead = self.fail[at] == NOWHERE
        lost[rows[dead]] = True
        rows, sign, at = rows[~dead], sign[~dead], at[~dead]
        count[rows] += self.popped[at]
        state[rows] = self.fail[at]
        return rows, sign


@functools.cache
def loaded(path: str) -> LongestMatch:
    """The automaton of a byte-level vocabulary file whose pieces carry a mark at a word's end."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    sign = {chr(b): b for b in PRINTABLE}
    sign |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
    pieces = []
    for piece in vocabulary:
        bare = piece.removesuffix(SUFFIX)
        if bare and set(bare) <= sign.keys():
            pieces.append((*map(sign.__getitem__, bare), *[END] * (bare != piece)))
    return LongestMatch(pieces)


def _learn(words: list[str], automaton: LongestMatch, cache: dict[str, int]) -> None:
    new = [x for x in dict.fromkeys(words) if x not in cache]
    if len(cache) + len(new) > KEPT_WORDS:
        cache.clear()
        new = list(dict.fromkeys(words))
    if new:
        parts = [PARTS.findall(x) for x in new]
        counts = automaton.counts([p.encode("utf-8", "surrogatepass") for some in parts for p in some])
        sizes = np.array([len(some) for some in parts])
        sums = np.append(0, np.cumsum(counts))
        ends = np.cumsum(sizes)
        cache.update(zip(new, (sums[ends] - sums[ends - sizes]).tolist(), strict=True))


def composed(text: str) -> str:
    """The text in the normal form C, as the vocabulary has it."""
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def count_tokens(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_words, n_tokens.

    Composed (NFC), lower-cased text is split at white space; each word is cut into runs of letters, single numbers
    and runs of other signs; each of those counts as many tokens as greedy longest matching from the
    left takes pieces, the end of the run being part of the match. A run that the vocabulary cannot
    spell counts one. Null and empty texts count 0; repeated rows count alike; a null id stays null;
    an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        automaton, cache = loaded(vocabulary_path), {}
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                split = [composed(x).lower().split() for x in some.column(1).to_pylist()]
                _learn([w for words in split for w in words], automaton, cache)
                totals = [sum(map(cache.__getitem__, words)) for words in split]
                columns = [some.column(0), pa.array(map(len, split), pa.int64()), pa.array(totals, pa.int64())]
                yield pa.record_batch(columns, names=["id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_tokens long").withColumnRenamed("id", id_col)
