"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import as_text


def fold(key: str, parts: int) -> Column:
    """The remainder of the id's CRC-32 that names a row's fold; null ids have none."""
    return F.crc32(F.col(key).cast("string")) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, each: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, y) of at most `each` rows of either label, in the order of a hash of their ids.

    The ids are chosen from the labels alone, so at most 2 * `each` of them meet the documents in a broadcast."""
    known = labels.where(train & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64("id")
    chosen = [known.where(F.col("y") == y).orderBy(order, "id").limit(each) for y in (0, 1)]
    return docs.select(F.col(key).alias("id"), as_text(docs, text).alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), "id").select("id", "text", "y")
