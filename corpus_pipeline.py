"""The corpus pipeline: filters, near copies, decontamination and a token round trip, a stage each.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns rows with
the columns of documents; the last returns its digests. `run` writes each stage as Parquet in the shared
folder, reads it for the next and removes what lies before. Verdicts hold for rows, whatever their ids: scores are
given with the row, contamination by the text, and near copies by a number of the row.

For every stage: a null or empty text is a text without words; a null, shared or repeated id is no key; repeated
rows fare alike but in near_copies, which keeps one; a text of any length is judged whole; an empty table gives an
empty one; a column of any other name is kept, whatever it is called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe_chunks, decontam, neardup, quality_mil, toxicity_crf
from tidemark.llm.queries import TOKENIZER, table
from tidemark.llm.sampling import fold
from tidemark.llm.storage import file_system, fresh_path, scratch, small_batches, stored


MOST_FILES = 100_000


def _free(name: str, docs: DataFrame) -> str:
    """A column name that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number for each row, and its column's name. A row that is read from a file has its place there, the
    same however often it is read; only rows from elsewhere are written once to be numbered."""
    row, file, place = (_free(c, docs) for c in ("row", "file", "place"))
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
        # One row a file; more than MOST_FILES are not broadcast, and their rows are written to be numbered.
        known = placed.select(file).distinct().withColumn(row, F.row_number().over(Window.orderBy(file)).cast("long"))
        if "_metadata" not in docs.columns and known.count() <= MOST_FILES:
            return placed.join(F.broadcast(known), file).withColumn(row, F.shiftleft(row, 40) + F.col(place)).select(*docs.columns, row), row
    except AnalysisException:  # not rows of a file
        pass
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the field learns from the labelled rows of its own input."""
    small_batches(spark)
    with scratch(spark):
        model = toxicity_crf.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity_crf.score(docs, model, whole=True).where("predicted = 0").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted good go."""
    small_batches(spark)
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return quality_mil.score(docs, model, whole=True).where("predicted = 1").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays: the one with the least id, those without id
    last, and the first of repeated rows. Texts without words are copies of nothing but rows that repeat id and text."""
    small_batches(spark)
    rows, row = _numbered(docs)
    first = fresh_path(spark, "first")
    with scratch(spark):
        verdicts = neardup.near_duplicates(rows.select(F.col(row).alias("row"), "text"), key="row")
        blank = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text"))
        known = verdicts.join(rows.select(F.col(row).alias("row"), "doc_id", blank.alias("blank")), "row")
        wordless, order = F.col("n_shingles") == 0, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
        known.groupBy(
            F.when(~wordless | F.col("doc_id").isNull(), F.col("component_id")).alias("component"),
            F.when(wordless, F.col("doc_id")).alias("its_id"), F.when(wordless, F.col("blank")).alias("its_text")).agg(F.min(order).alias("first")).select(
            F.col("first.row").alias(row)).write.parquet(first)
    return rows.join(spark.read.parquet(first), row, "left_semi").select(docs.columns)


def _text_key() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    mark, bad = _free("mark", docs), fresh_path(spark, "contaminated")
    with scratch(spark):
        judged = decontam.contamination(docs.select(_text_key().alias("key"), "text"), table(spark, sf_dir, "benchmark"), key="key")
        judged.where("contaminated").select(F.col("key").alias(mark)).distinct().write.parquet(bad)
    return docs.withColumn(mark, _text_key()).join(spark.read.parquet(bad), mark, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts of what is left, as counts and digests."""
    small_batches(spark)
    return bpe_chunks.encode_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL has no words for the learned stages and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            fs, old = file_system(before)
            fs.delete_dir(old)
        before = path
    return docs
