"""Quality: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; learned filters look at eight bytes at every fourth position.
Their responses are max-pooled over chunks that overlap by half and together cover the whole text. A
text is described by each filter's mean, greatest and least chunk maximum (the least shows stretches
in which nothing new happens) and a linear layer makes one probability of that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import labelled_sample, scored

EMBEDDED, BLOCK, FILTERS = 4, 4, 24
#: Filter positions of half a chunk.
HALF = 32
#: A worker's bytes in work at once.
BYTES_AT_ONCE = 1_000_000


@dataclass
class Network:
    embedding: np.ndarray  # (257, EMBEDDED); row 256 is padding
    filters: np.ndarray  # (2, BLOCK * EMBEDDED, FILTERS): over this block and the next
    offset: np.ndarray
    weights: np.ndarray  # (3 * FILTERS,)
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.offset, self.weights, self.bias]


def laid_out(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, each padded to whole half-chunks, and one block of padding behind
    them all; half-chunks of each."""
    unit = HALF * BLOCK
    halves = np.array([max(1, -(-len(x) // unit)) for x in raws], np.int64)
    sizes = halves * unit
    out = np.full(int(sizes.sum()) + BLOCK, 256, np.int16)
    low = np.cumsum(sizes) - sizes
    for raw, at in zip(raws, low.tolist(), strict=True):
        out[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
    return out, halves


def following(points: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """The block after each block of a layout. Behind a text's last block there is padding, not the
    next text, so that a text's responses are its own."""
    after = points.reshape(-1, BLOCK)[1:].copy()
    after[np.cumsum(halves) * HALF - 1] = 256
    return after


def responses(net: Network, here: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The filters' responses at blocks, with the block after each. Every byte value has a vector of
    responses for each of the eight places, and those are added in a fixed order: unlike a matrix
    product, the sum does not depend on how many blocks are worked on at once."""
    kernels = np.concatenate(net.filters, 0).reshape(2 * BLOCK, EMBEDDED, FILTERS)
    tables = net.embedding @ kernels  # (place, byte, filter)
    total = tables[0][here[:, 0]] + net.offset
    for k in range(1, 2 * BLOCK):
        total += tables[k][here[:, k] if k < BLOCK else after[:, k - BLOCK]]
    return total


def _chunks(half: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk maxima (at least 0), each half-chunk with the next one of its text, and which have one."""
    chunk = np.maximum(half, 0)
    joined = np.ones(len(half), bool)
    joined[np.cumsum(halves) - 1] = False
    chunk[:-1][joined[:-1]] = np.maximum(chunk[:-1], half[1:])[joined[:-1]]
    return chunk, joined


def pooled(net: Network, points: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_chunks of a layout."""
    value = responses(net, points.reshape(-1, BLOCK)[:-1], following(points, halves))
    return _chunks(value.reshape(-1, HALF, FILTERS).max(1), halves)


def described(chunk: np.ndarray, halves: np.ndarray) -> np.ndarray:
    low = np.cumsum(halves) - halves
    mean = np.add.reduceat(chunk, low) / halves[:, None]
    return np.hstack([mean, np.maximum.reduceat(chunk, low), np.minimum.reduceat(chunk, low)])


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def train(texts: list[str], labels: np.ndarray, epochs: int = 10, batch: int = 48, seed: int = 11) -> Network:
    random = np.random.default_rng(seed)
    net = Network(
        random.normal(0, 0.5, (257, EMBEDDED)).astype(np.float32),
        random.normal(0, 0.25, (2, BLOCK * EMBEDDED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(3 * FILTERS, np.float32),
        np.zeros(1, np.float32),
    )
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    net.bias[:] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        return net
    raws = [x.encode("utf-8", "surrogatepass") for x in texts]
    first = [np.zeros_like(x) for x in net.parameters()]
    second = [np.zeros_like(x) for x in net.parameters()]
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(raws))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for some in np.array_split(order, max(1, len(order) // batch)):
            step += 1
            gradients = backward(net, [raws[k] for k in some], labels[some])
            for x, g, m, v in zip(net.parameters(), gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def backward(net: Network, raws: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """The gradients of the mean log loss."""
    points, halves = laid_out(raws)
    span, after = points.reshape(-1, BLOCK)[:-1], following(points, halves)
    value = responses(net, span, after).reshape(-1, HALF, FILTERS)
    where = value.argmax(1)
    half = np.take_along_axis(value, where[:, None], 1)[:, 0]
    where = where + np.arange(len(half))[:, None] * HALF
    low = np.cumsum(halves) - halves
    joined = np.ones(len(half), bool)
    joined[low + halves - 1] = False
    take = np.zeros(half.shape, bool)
    take[:-1] = joined[:-1, None] & (half[1:] > half[:-1])
    where[:-1] = np.where(take[:-1], where[1:], where[:-1])
    chunk = np.maximum(np.where(take, np.roll(half, -1, 0), half), 0)
    features = described(chunk, halves)
    error = (probability(features @ net.weights + net.bias) - labels) / len(labels)
    back = (error[:, None] * net.weights).astype(np.float32)
    owner = np.repeat(np.arange(len(halves)), halves)
    change = (back[:, :FILTERS] / halves[:, None])[owner]
    for k, extreme in ((1, np.maximum), (2, np.minimum)):
        best = extreme.reduceat(chunk, low)[owner] == chunk
        ties = np.add.reduceat(best.astype(np.float32), low)[owner]
        change = change + best * back[:, k * FILTERS : (k + 1) * FILTERS][owner] / ties
    change = np.where(chunk > 0, change, 0).astype(np.float32)
    seen = np.concatenate([span[where], after[where]], 2)  # (chunk, filter, 8 bytes)
    inputs = net.embedding[seen].reshape(*where.shape, 2 * BLOCK * EMBEDDED)
    kernels = np.concatenate(net.filters, 0)  # (8 * EMBEDDED, FILTERS)
    to_kernels = np.einsum("cfi,cf->if", inputs, change)
    to_inputs = (change[:, :, None] * kernels.T[None]).reshape(-1, EMBEDDED)
    flat = seen.ravel()
    to_embedding = np.stack([np.bincount(flat, to_inputs[:, d], 257) for d in range(EMBEDDED)], 1)
    return [
        to_embedding.astype(np.float32),
        to_kernels.reshape(net.filters.shape),
        change.sum(0),
        (features.T @ error).astype(np.float32) + 1e-4 * net.weights,
        error.sum(keepdims=True).astype(np.float32),
    ]


def scores(texts: list[str], net: Network) -> np.ndarray:
    """The chance of each text to be good, a function of that text alone. Long texts are taken in stretches that overlap as the
    chunks do, so that memory stays bounded and nothing is left out."""
    raws = [x.encode("utf-8", "surrogatepass") for x in texts]
    out, low = np.empty(len(raws)), 0
    while low < len(raws):
        high, size = low, 0
        while high < len(raws) and (high == low or size + len(raws[high]) <= BYTES_AT_ONCE):
            size += len(raws[high])
            high += 1
        features = _long(raws[low], net) if size > BYTES_AT_ONCE else _short(raws[low:high], net)
        out[low:high] = probability((features * net.weights.astype(np.float64)).sum(1) + net.bias)
        low = high
    return out


def _short(raws: list[bytes], net: Network) -> np.ndarray:
    points, halves = laid_out(raws)
    return described(pooled(net, points, halves)[0], halves)


def _long(raw: bytes, net: Network) -> np.ndarray:
    points, halves = laid_out([raw])
    span, after = points.reshape(-1, BLOCK)[:-1], following(points, halves)
    stride = BYTES_AT_ONCE // (HALF * BLOCK) * HALF
    half = [
        responses(net, span[at : at + stride], after[at : at + stride]).reshape(-1, HALF, FILTERS).max(1)
        for at in range(0, len(span), stride)
    ]
    return described(_chunks(np.concatenate(half), halves)[0], halves)


def rows_with_quality(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """(row, score): docs' rows, whole, with their scores."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    return scored(docs, lambda: lambda texts: scores(texts, held.value), text_col)


def score_quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score in 0 to 1.

    Null and empty texts score as one chunk of padding. Repeated rows score alike; a null id stays
    null; an empty table gives no rows; other columns are not read.
    """
    rows = rows_with_quality(docs.select(id_col, F.col(text_col).cast("string").alias("text")), net)
    return rows.select(F.col("row")[id_col].alias(id_col), "score")


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, longest: int = 10_000) -> Network:
    """Learns from at most per_class labelled rows of each class outside the held-out fold. Without any,
    or with one class alone, all texts score alike: a half, or nearly what that class says. Null ids and
    labels other than 0 and 1 count for nothing; an id with several labels counts once, as 1 if any is."""
    texts, marks = labelled_sample(docs, labels, "quality", per_class, longest)
    return train(texts, marks)
