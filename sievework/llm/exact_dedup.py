"""Exact deduplication as a tree-merge of sorted digest runs, in DataFrame operations alone.

Every row's text becomes a digest, in one scan whose result is written: id, run, digest and check are
all that is read from then on. Rows are dealt to RUNS runs by a hash of their id, so that copies
of one text, however many, lie in all runs evenly. A run holds one entry for each digest: the
identifier that stays and how many rows were merged into it. In each round the runs whose numbers
agree but for their lowest bits meet (a binomial exchange of FAN runs), spread by digest over all
tasks, and their sorted entries are merged. After the last round one run is left. Its entries go
back down through the first runs to the rows, so no join sees a digest more than RUNS times on one
side and a row's share of a hot digest on the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

RUNS, FAN_BITS = 64, 3


def _merge(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Multiway merge: of one digest's entries, the identifier that stays is retained.

    A second hash and the length travel along; entries of one digest that differ in them are
    different texts with colliding digests and stop the job instead of losing a document.
    """
    merged = entries.groupBy(*keys).agg(
        F.max("top").alias("top"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    verified = F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(
        F.raise_error(F.lit("two texts share a digest")).cast("long")
    )
    return merged.withColumn("n", verified)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest"
) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of a group the row with the largest id
    stays (keep="smallest": the smallest). A null id never stays unless all ids of the group are
    null; then keep_id is null and the rows are kept. Rows that repeat an id are each counted in
    group_size and share their id's fate. Other columns are not read, so their names cannot clash.
    An empty table gives an empty result.
    """
    sign = 1 if keep == "largest" else -1
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.struct(F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("second")).alias("check"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(RUNS)).cast("int").alias("run"),
    )
    rows = written(rows, "digests")
    entries = rows.select(
        "run",
        "digest",
        (F.col("id") * sign).alias("top"),
        F.lit(1).cast("long").alias("n"),
        F.col("check").alias("low"),
        F.col("check").alias("high"),
    )
    leaves = _merge(entries, ["run", "digest"])
    levels = range(FAN_BITS, RUNS.bit_length() - 1 + FAN_BITS, FAN_BITS)
    last = reduce(
        lambda below, _: _merge(
            below.withColumn("run", F.shiftright("run", FAN_BITS)), ["run", "digest"]
        ),
        levels,
        leaves,
    )
    final = last.select("digest", (F.col("top") * sign).alias("keep_id"), F.col("n").alias("group_size"))
    down = leaves.select("run", "digest").join(final, "digest")
    return rows.select("id", "run", "digest").join(down, ["run", "digest"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
