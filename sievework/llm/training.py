"""What the classifiers share: the bounded labelled sample, and scoring of whole rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, text_of, tidy


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most per_class rows of each class: those first by a hash of their id.

    The held-out fold (crc32 of the id as text, a multiple of 5), null ids and labels, and texts of
    more than longest characters are left out, which bounds what reaches the driver at
    2 * per_class * longest characters. An id with several labels has the greatest. The ids are drawn
    from the labels of documents that exist and may be used, so that as many are learned from as are
    stated; texts are read in the second pass, of the chosen ids alone, which are at most 2 * per_class
    rows and are broadcast for that reason.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id")
    )
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select("doc_id", text_of("text").alias("text")).where(F.length("text").between(1, longest))
    usable = usable.join(rows.select("doc_id"), "doc_id", "left_semi")
    rank = F.xxhash64(F.col("doc_id"), F.lit(label))
    chosen = [usable.where(F.col("y") == y).orderBy(rank, "doc_id").limit(per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    found = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").toArrow().sort_by(
        [("doc_id", "ascending"), ("text", "ascending")]
    )
    return found["text"].to_pylist(), np.array(found["y"].to_pylist(), np.int64)


def scored(docs: DataFrame, scorer: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str) -> DataFrame:
    """(row, score): each row of docs as a struct, so that no name can clash, and its score.

    scorer is called once in each task and gives the function that scores a list of texts; null
    texts are empty.
    """
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])

    def run(batches):
        score = scorer()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                row = batch.slice(low, 256).column(0)
                texts = [x or "" for x in row.field(text_col).to_pylist()]
                yield pa.record_batch([row, pa.array(score(texts), pa.float64())], names=["row", "score"])

    return docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row")).mapInArrow(tidy(run), schema)
