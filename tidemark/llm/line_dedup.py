"""Lines that many documents share are taken out: lines are exploded, hashed, counted by distinct documents,
dropped above a threshold and the rest put together again by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import as_text, stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines are counted by buckets of their digest first; a digest can only be hot in a hot bucket.
BUCKETS = 65_536
#: A digest with more than one in HOT of all lines is hot, so there are fewer than HOT of them.
HOT = 1_000


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text and `row`, which rows of one id and one text share: what happens to one happens to all."""
    one = docs.select(F.col(key).cast("long").alias("doc_id"), as_text(docs, text).alias("text"))
    return one.withColumn("row", _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))


def line_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, digest) of lines whose key has at least `min_chars` code points."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    lines = documents.select("doc_id", "row", F.posexplode(trimmed).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    return lines.select("doc_id", "row", "pos", _digest(F.translate("line", UPPER, LOWER)).alias("digest"))


def _hot(lines: DataFrame) -> DataFrame:
    """The digests of more than one line in HOT. Buckets are summed before the shuffle, and only lines of hot buckets
    are counted by digest; by the pigeonhole principle fewer than HOT buckets and digests pass."""
    total, bucket = lines.count(), F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("bucket")
    full = lines.groupBy(bucket).agg(F.count("*").alias("n")).where(F.col("n") * HOT > total).select("bucket")
    counts = lines.select("digest", bucket).join(F.broadcast(full), "bucket").groupBy("digest").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") * HOT > total).select("digest")


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(row, pos) of lines whose digest at least `min_docs` documents hold, but for those of the largest id.

    Hot digests are counted by distinct (digest, document) pairs, spread by both, and their verdicts, fewer than
    HOT rows, are broadcast. All others are shuffled once by digest, where a group is less than one line in HOT.
    """
    hot = stored(_hot(lines), "hot-lines")
    pairs = lines.join(F.broadcast(hot), "digest").groupBy("digest", "doc_id").agg(F.lit(1).alias("one"))
    verdict = pairs.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    often = lines.join(F.broadcast(verdict), "digest")
    by_id = Window.partitionBy("digest").orderBy("doc_id")
    rare = (lines.join(F.broadcast(hot), "digest", "left_anti").withColumn("nth", F.dense_rank().over(by_id))
            .withColumn("n", F.max("nth").over(Window.partitionBy("digest"))).withColumn("last", F.max("doc_id").over(Window.partitionBy("digest")))
            .where(F.col("n") >= min_docs))
    found = [x.where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("row", "pos") for x in (often, rare)]
    return found[0].unionByName(found[1])


def _without(text: str, dropped: str) -> Column:
    """The text without the lines at the ascending places `dropped`, in one pass: the stretches between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda d: d + 1))

    def rest(lines: Column) -> Column:
        ends = F.concat(F.col(dropped), F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    return F.transform(F.array(F.split(text, "\n")), rest)[0]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (what is left), n_lines (before dropping), n_dropped; a row per row of `docs`.

    A line ends at a line feed; its key is the line without blanks at both ends, A-Z in lower case. Keys of at
    least `min_chars` code points that at least `min_docs` documents hold lose all their lines except in the
    largest id that holds them. Documents are told apart by id: rows of one id count once, those without id
    count as one document before all others. A null or empty text is one empty line; a text that loses all its
    lines is empty. Texts of any length are handled whole, as one value; an empty table gives an empty one;
    other columns are ignored.
    """
    documents = _documents(docs, key, text)
    lines = stored(line_keys(documents, min_chars), "lines")
    # At most the lines of one text.
    dropped = shared_lines(lines, min_docs).groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    met = documents.join(dropped, "row", "left")
    return met.select("doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_without("text", "dropped")).alias("text"),
                      F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
                      F.coalesce(F.array_size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
