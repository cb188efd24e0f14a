"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

Vectors are normalised and turned by a fixed random rotation, then cut into BLOCKS stretches. Each
stretch has a random code of unit vectors; a filter direction is one codeword per stretch, and
its product with a vector is the sum of the stretches' products. A vector passes all filters whose
product exceeds a threshold. List decoding finds them without trying all of them: stretches'
products are sorted, and a partial choice is dropped once even the best rest cannot reach the
threshold. The threshold is a vector's own: the product of its best direction but so many (filters()),
so every vector passes the same number of filters. One threshold for all was tried: in 64 dimensions
and with 16 codewords it needs 31 filters a vector to find 0.58 of the pairs at 0.95, where the own
threshold finds over 0.99 with 32, since stretches differ in length from vector to vector.

Equal vectors are one class before that. Ids meet in filters' lists first. A list of more than SIDE
vectors is cut into square blocks; all other lists go by regions of neighbouring filters (equal first
halves of their directions), so that a vector travels once for each region that it is in, not once
for each filter. Cosines are computed in double precision. A pair is counted in the first filter that
both pass, so n_links is exact for the pairs found, and no pair is ever emitted: a region or block
gives each vector's count of links and a star of links for its components.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, tidy, written
from .components import components, stars

BLOCKS = 4
#: The fewest codewords of a stretch. With more vectors there are more, so that filters' lists stay short.
LEAST_CODE = 16
#: Vectors of a filter's list that one task holds at most, as a square block of pairs.
SIDE = 2048
#: Vectors of a region beyond which its filters are dealt over several units.
REGION = 32_768


def filters(code: int) -> int:
    """How many filters a vector passes: more with more codewords, so that recall stays."""
    return math.ceil(8 * math.sqrt(code))


@functools.cache
def codes(width: int, code: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The rotation, padded to whole stretches, and the codebook (BLOCKS, code, stretch)."""
    random = np.random.default_rng(seed + width)
    stretch = -(-width // BLOCKS)
    turn = np.zeros((width, BLOCKS * stretch))
    turn[:, :width] = np.linalg.qr(random.normal(size=(width, width)))[0]
    book = random.normal(size=(BLOCKS, code, stretch))
    return turn, book / np.linalg.norm(book, axis=2, keepdims=True)


def filters_of(vectors: np.ndarray, code: int = LEAST_CODE) -> np.ndarray:
    """The filters(code) best filter directions of each unit vector, ascending by number.

    Stretches are joined one after the other. Of the sums so far only those are kept that can be
    among a vector's best: any other partial choice is beaten by as many with the same rest.
    """
    most = filters(code)
    turn, book = codes(vectors.shape[1], code)
    stretches = (vectors @ turn).reshape(len(vectors), BLOCKS, -1)
    products = np.einsum("nbs,bcs->nbc", stretches, book)
    best, number = products[:, 0], np.broadcast_to(np.arange(code, dtype=np.int64), (len(vectors), code))
    for k in range(1, BLOCKS):
        # the r-th best partial choice can only be used with the most / r best codewords
        order = np.argsort(-products[:, k], 1, kind="stable")
        ranked = np.take_along_axis(products[:, k], order, 1)
        partial = np.argsort(-best, 1, kind="stable")[:, :most]
        best, number = np.take_along_axis(best, partial, 1), np.take_along_axis(number, partial, 1)
        pairs = [(r, c) for r in range(best.shape[1]) for c in range(code) if (r + 1) * (c + 1) <= most]
        r, c = np.array(pairs).T
        sums = best[:, r] + ranked[:, c]
        top = np.argpartition(-sums, min(most, sums.shape[1]) - 1, 1)[:, :most]
        best = np.take_along_axis(sums, top, 1)
        number = np.take_along_axis(number[:, r] * code + order[:, c], top, 1)
    return np.sort(number, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _unit(rows: np.ndarray) -> np.ndarray:
    vectors = rows.astype(np.float64)
    vectors /= np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _signatures(classes: DataFrame, code: int) -> DataFrame:
    """(rep, width, filters): what each vector passes."""

    def run(batches):
        for batch in batches:
            widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                own = batch.filter(pa.array(widths == width))
                for low in range(0, own.num_rows, 1024):
                    some = own.slice(low, 1024)
                    found = filters_of(_unit(_matrix(some.column(1), width)), code)
                    listed = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())
                    yield pa.record_batch([some.column(0), pa.array(np.full(len(found), width, np.int32)), listed], names=["rep", "width", "filters"])

    return classes.mapInArrow(tidy(run), "rep long, width int, filters array<long>")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that is in both of two rows."""
    both = np.sort(np.hstack([a, b]), 1)
    return np.where(both[:, 1:] == both[:, :-1], both[:, 1:], np.iinfo(np.int64).max).min(1)


#: Products of two lists that are taken at a time.
CELLS = 1_000_000


def _in_lists(vectors: np.ndarray, passed: np.ndarray, filter_: np.ndarray, row: np.ndarray, least: float):
    """The linked pairs (a, b) of a region whose first common filter is one of its lists. filter_ and
    row are the entries of the lists. Lists of like length are multiplied at once."""
    order = np.argsort(filter_, kind="stable")
    filter_, row = filter_[order], row[order]
    starts = np.flatnonzero(np.diff(filter_, prepend=-1))
    sizes = np.diff(starts, append=len(filter_))
    by_size = np.argsort(sizes, kind="stable")
    by_size = by_size[sizes[by_size] > 1]
    while len(by_size):
        side = int(sizes[by_size[-1]])
        some, by_size = np.split(by_size, [max(0, len(by_size) - max(1, CELLS // side**2))])[::-1]
        place = starts[some][:, None] + np.minimum(np.arange(side), sizes[some][:, None] - 1)
        members = row[place]
        held = vectors[members]
        near = held @ held.transpose(0, 2, 1) >= least - 1e-9
        n, x, y = np.nonzero(near)
        keep = (x < y) & (y < sizes[some][n])
        n, a, b = n[keep], members[n[keep], x[keep]], members[n[keep], y[keep]]
        yield from _sure(vectors, passed, filter_[starts[some]][n], a, b, least)


def _in_block(vectors: np.ndarray, passed: np.ndarray, own: int, least: float, half: np.ndarray, same: bool):
    """The linked pairs (a, b) of a block whose first common filter is own. half tells its two sides
    apart: pairs within one side belong to the block of that side with itself."""
    sides = [np.flatnonzero(half == 0), np.flatnonzero(half == 1)]
    for one in range(0, len(sides[0]), 512):
        a = sides[0][one : one + 512]
        b = sides[0] if same else sides[1]
        x, y = np.nonzero(vectors[a] @ vectors[b].T >= least - 1e-9)
        x, y = a[x], b[y]
        keep = x < y if same else x != y
        yield from _sure(vectors, passed, np.full(int(keep.sum()), own), x[keep], y[keep], least)


def _sure(vectors, passed, filter_, a, b, least):
    """Of these pairs those that link, and for the first time."""
    for low in range(0, len(a), 50_000):
        f, p, q = (x[low : low + 50_000] for x in (filter_, a, b))
        sure = (vectors[p] * vectors[q]).sum(1) >= least
        f, p, q = f[sure], p[sure], q[sure]
        first = _first_common(passed[p], passed[q]) == f
        yield p[first], q[first]


def _met(units: DataFrame, least: float) -> DataFrame:
    """(u, v, n): for u = v the links counted for a vector, with all copies of the others; else stars."""

    def found(rows: pa.RecordBatch):
        width, place, i, j = (rows.column(k)[0].as_py() for k in range(4))
        half, reps, copies = (rows.column(k).to_numpy() for k in (4, 5, 6))
        vectors = _unit(_matrix(rows.column(9), width))
        passed = _matrix(rows.column(8), len(rows.column(8)[0]))
        if j < 0:
            own = rows.column(7)
            row = np.repeat(np.arange(len(reps)), pc.list_value_length(own).to_numpy())
            pairs = _in_lists(vectors, passed, own.flatten().to_numpy(), row, least)
        else:
            pairs = _in_block(vectors, passed, place, least, half, i == j)
        counts, tree = np.zeros(len(reps)), []
        for a, b in pairs:
            counts += np.bincount(a, copies[b], len(reps)) + np.bincount(b, copies[a], len(reps))
            tree += [x for x in stars([np.stack([reps[a], reps[b]], 1)]) if x.num_rows]
        hit = np.flatnonzero(counts)
        u = np.concatenate([reps[hit], *(x.column(0).to_numpy() for x in tree)])
        v = np.concatenate([reps[hit], *(x.column(1).to_numpy() for x in tree)])
        n = np.concatenate([counts[hit], np.zeros(len(u) - len(hit))]).astype(np.int64)
        return pa.record_batch([pa.array(u), pa.array(v), pa.array(n)], names=["u", "v", "n"])

    def run(batches):
        """Units follow each other; one may go on in the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], 1)
            if not len(keys):
                continue
            if held and (keys[0] != [held[0].column(k)[0].as_py() for k in range(4)]).any():
                yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(low, high - low))
                if high < len(keys):
                    yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return units.mapInArrow(tidy(run), "u long, v long, n long")


def near_vectors(
    table: DataFrame,
    least: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    side: int = SIDE,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors link at cosine >= least, computed in double precision, among vectors of equal length.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
    n_links counts the other rows linked directly, equal vectors among them; component_id is the
    smallest id reachable; kept marks it. Rows that repeat an id count as rows of their own in
    n_links and share the largest; a null id links with nothing. An empty table gives no rows.
    The search is approximate: a pair that passes no common filter is missed (see the README for
    the measured recall); no pair below the threshold is ever linked.
    """
    kind = table.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    vector = F.col(vector_col).cast(f"array<{kind}>").alias("vector")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    zero = F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))
    valid = written(rows.where("id IS NOT NULL").where(F.coalesce(fine & some, F.lit(False))).select("id", zero.alias("vector")), "vectors")
    key = [F.xxhash64("vector").alias("key"), F.col("vector")]
    classes = valid.select("id", *key).groupBy("key", "vector")
    classes = written(classes.agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    code = max(LEAST_CODE, math.ceil(classes.count() ** (1 / BLOCKS)))
    signed = written(_signatures(classes.select("rep", "vector"), code), "signatures")
    listed = signed.select("width", F.explode("filters").alias("filter"), "rep")
    lists = listed.groupBy("width", "filter").agg(F.count("*").alias("many")).where("many > 1")
    lists = written(lists.select("width", "filter", F.ceil(F.col("many") / side).alias("parts")), "lists")
    met = listed.join(lists, ["width", "filter"])
    # lists in square blocks
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    blocks = met.where("parts > 1").select("width", "filter", "rep", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = blocks.select(
        "width", F.col("filter").alias("place"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).cast("int").alias("half"), "rep", F.array("filter").alias("own"),
    )
    # all others by region, the filters of a large one dealt over several units
    short = met.where("parts = 1").withColumn("place", F.floor(F.col("filter") / code ** (BLOCKS // 2)))
    short = written(short.groupBy("width", "place", "rep").agg(F.collect_list("filter").alias("own")), "regions")
    many = short.groupBy("width", "place").agg(F.ceil(F.count("*") / REGION).alias("units")).where("units > 1")
    many = written(many, "large")
    dealt = short.join(many, ["width", "place"], "left").withColumn("units", F.coalesce("units", F.lit(1).cast("long")))
    dealt = dealt.withColumn("f", F.explode("own")).groupBy("width", "place", F.pmod("f", "units").alias("i"), "rep").agg(F.collect_list("f").alias("own"))
    whole = short if many.isEmpty() else dealt
    own = F.lit(0).cast("long") if many.isEmpty() else F.col("i")
    regions = whole.select("width", "place", own.alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).alias("half"), "rep", "own")
    data = signed.select("rep", "filters").join(classes.select("rep", "copies", "vector"), "rep")
    units = regions.unionByName(blocks).join(data, "rep")
    units = units.select(F.col("width").cast("long").alias("width"), "place", "i", "j", "half", "rep", "copies", "own", "filters", "vector")
    unit = ["width", "place", "i", "j"]
    links = written(_met(units.repartition(*unit).sortWithinPartitions(*unit), least), "links")
    drop_written(signed, lists, short, many)
    counts = links.where("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    own = classes.join(counts, "rep", "left")
    own = own.select("key", "vector", "rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = components(links.select("u", "v").where("u <> v"))
    own = own.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.select("key", "vector", "n_links", F.coalesce("component", "rep").alias("component_id"))
    own = written(own, "own")  # a plain exchange on both sides of the next join, whose hot keys Spark can split
    drop_written(classes, links, joined)
    result = valid.select("id", *key).join(own, ["key", "vector"]).groupBy("id")
    result = result.agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "id")
    return rows.select("id").join(result, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
