"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of itself, all hashed into
one table, so that a misspelling nobody has seen shares most of its vector with the word it bends.
Vectors are averaged over windows of words that overlap and together cover the whole text, a short
window being filled up with zeros; the text scores as its most toxic window, because one insult in a long text is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import points_of, spread
from .training import labelled_sample, scored

BUCKETS_BITS, DIMENSIONS, GRAMS = 17, 8, (3, 4, 5)
WINDOW, STEP = 16, 8
#: What may surround a word without being part of it.
EDGES = ".,;:!?\"'()[]{}|-–—…«»“”„¡¿*#$%&"
OPEN, CLOSE = 2, 3
KEPT_WORDS = 400_000
#: The score of every text when there is nothing to learn from: below any threshold for rejecting.
UNTRAINED = 0.25


def words_of(text: str) -> list[str]:
    """Lower-cased words without their immediate repetitions."""
    found = text.lower().split()
    return [x for x, before in zip(found, [None, *found], strict=False) if x != before]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams and of the words themselves, and how many each word has."""
    bare = [x.strip(EDGES) or x for x in words]
    sizes = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
    ends = np.cumsum(sizes)
    marked = points_of("".join(f"\x02{x}\x03" for x in bare)).astype(np.uint64)
    owner = np.repeat(np.arange(len(bare)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(marked))  # signs up to the word's end
    mix, found, owners = np.uint64(0x9E3779B97F4A7C15), [], []
    rolled = np.zeros(len(marked), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted, later = np.zeros(len(marked), np.uint64), marked[n - 1 :]
        shifted[: len(later)] = later
        rolled = (rolled ^ shifted) * mix
        rolled ^= rolled >> np.uint64(29)
        if n in GRAMS:
            inside = left >= n
            found.append(rolled[inside])
            owners.append(owner[inside])
    weights = np.cumprod(np.full(int(sizes.max(initial=1)), mix, np.uint64))
    place = np.arange(len(marked)) - np.repeat(ends - sizes, sizes)
    whole = np.add.reduceat(marked * weights[place], ends - sizes) if len(bare) else np.empty(0, np.uint64)
    found.append(whole * mix)
    owners.append(np.arange(len(bare)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(found) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)
    return buckets[order], np.bincount(owner, minlength=len(bare))


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(counts) - counts) / counts.reshape(-1, *[1] * (values.ndim - 1))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of the windows of texts laid end to end, and how many each text has."""
    many = np.maximum(1, -(-np.maximum(sizes - WINDOW, 0) // STEP) + 1)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    low = place * STEP
    length = np.minimum(np.repeat(sizes, many) - low, WINDOW)
    return low + np.repeat(np.cumsum(sizes) - sizes, many), length, many


@dataclass
class Toxicity:
    """The trained model. A word's share of the logit is linear in its subwords, so all that
    scoring needs of vectors and softmax is one number for each bucket."""

    logits: np.ndarray
    bias: float

    def of_words(self, words: list[str]) -> np.ndarray:
        buckets, counts = subwords(words)
        return _means(self.logits[buckets], counts)


def train(texts: list[str], labels: np.ndarray, epochs: int = 24, seed: int = 7) -> Toxicity:
    """Fits vectors and softmax together. The first rounds take windows at random, the others the
    window that the model finds most toxic at the time.

    With labels of one class alone every text scores as the share of that class: clean ones keep all,
    toxic ones reject all. Without labels every text scores UNTRAINED, so that none is rejected."""
    random = np.random.default_rng(seed)
    split = [words_of(x) for x in texts]
    labels = np.array([y for x, y in zip(split, labels, strict=True) if x], np.int64)
    split = [x for x in split if x]
    vectors = random.normal(0, 0.1, (1 << BUCKETS_BITS, DIMENSIONS))
    soft = random.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1.0) / (len(labels) + 2.0) if len(labels) else UNTRAINED
        return Toxicity(np.zeros(1 << BUCKETS_BITS), float(np.log(share / (1 - share))))
    known = {w: k for k, w in enumerate(dict.fromkeys(w for x in split for w in x))}
    buckets, counts = subwords(list(known))
    offsets = np.cumsum(counts) - counts
    flat = np.array([known[w] for x in split for w in x])
    low, length, many = windows(np.array([len(x) for x in split]))
    first = np.cumsum(many) - many
    memory = [np.full_like(x, 1e-8) for x in (vectors, soft, bias)]

    def learn(x, gradient, held, rate):
        held += gradient**2
        x -= rate * gradient / np.sqrt(held)

    for epoch in range(epochs):
        if epoch < epochs // 6:
            chosen = np.concatenate([first + random.integers(0, many) for _ in range(2)])
            owner = np.tile(np.arange(len(split)), 2)
        else:
            logit = _means((vectors @ (soft[:, 1] - soft[:, 0]))[buckets], counts)[flat]
            sums = np.append(0, np.cumsum(logit))
            score = (sums[low + length] - sums[low]) / WINDOW
            best = np.maximum.reduceat(score, first)
            hits = np.flatnonzero(score == np.repeat(best, many))
            owner, at = np.unique(np.repeat(np.arange(len(split)), many)[hits], return_index=True)
            chosen = hits[at]
        order = random.permutation(len(chosen))
        for some in np.array_split(order, max(1, len(order) // 128)):
            at = chosen[some]
            words = flat[spread(length[at], low[at])]
            grams = buckets[spread(counts[words], offsets[words])]
            word = _means(vectors[grams], counts[words])
            mean = _means(word, length[at]) * (length[at] / WINDOW)[:, None]
            logit = mean @ soft + bias
            chance = np.exp(logit - logit.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(some)), labels[owner[some]]] -= 1
            chance /= len(some)
            share = np.repeat((chance @ soft.T) / WINDOW, length[at], 0) / counts[words][:, None]
            touched, where = np.unique(grams, return_inverse=True)
            share = np.repeat(share, counts[words], 0)
            change = np.stack([np.bincount(where, share[:, d], len(touched)) for d in range(DIMENSIONS)], 1)
            memory[0][touched] += change**2
            vectors[touched] -= 0.25 * change / np.sqrt(memory[0][touched])
            learn(soft, mean.T @ chance, memory[1], 0.1)
            learn(bias, chance.sum(0), memory[2], 0.1)
    return Toxicity(vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def scores(texts: list[str], model: Toxicity, cache: dict[str, float]) -> np.ndarray:
    """The chance of each text to be toxic, a function of that text alone; one without words has the
    bias alone."""
    split = [words_of(x) for x in texts]
    new = [w for w in dict.fromkeys(w for x in split for w in x) if w not in cache]
    if len(cache) + len(new) > KEPT_WORDS:
        cache.clear()
        new = list(dict.fromkeys(w for x in split for w in x))
    if new:
        cache.update(zip(new, model.of_words(new).tolist(), strict=True))
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    logit = np.fromiter((cache[w] for x in split for w in x), np.float64, int(sizes.sum()))
    low, length, many = windows(sizes)
    # each window is summed for itself, so that a score does not depend on the texts beside it
    sums = np.add.reduceat(np.append(logit, 0), np.stack([low, low + length], 1).ravel())[::2] if len(low) else logit
    value = np.where(length > 0, sums, 0) / WINDOW
    top = np.maximum.reduceat(value, np.cumsum(many) - many) + model.bias if len(sizes) else value
    return 1 / (1 + np.exp(-np.clip(top, -500, 500)))


def rows_with_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """(row, score): docs' rows, whole, with their scores."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        cache: dict[str, float] = {}
        return lambda texts: scores(texts, held.value, cache)

    return scored(docs, scorer, text_col)


def score_toxicity(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score in 0 to 1.

    A word written several times in a row counts once (words_of), in training and in scoring, so an
    insult that is repeated scores as the same insult written once.
    Null and empty texts and texts of white space score as the model's bias says. Repeated rows
    score alike; a null id stays null; an empty table gives no rows; other columns are not read.
    """
    rows = rows_with_toxicity(docs.select(id_col, F.col(text_col).cast("string").alias("text")), model)
    return rows.select(F.col("row")[id_col].alias(id_col), "score")


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 10_000) -> Toxicity:
    """Learns from at most per_class labelled rows of each class outside the held-out fold. If there
    are none, as with an empty table of labels, no text is taken for toxic (UNTRAINED); with one class
    alone every text scores as that class says. Null ids and labels other than 0 and 1 count for
    nothing; an id with several labels counts once, as 1 if any of them is."""
    texts, marks = labelled_sample(docs, labels, "toxic", per_class, longest)
    return train(texts, marks)
