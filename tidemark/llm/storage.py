"""Places every executor can read: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_FOLDER: ContextVar[str | None] = ContextVar("scratch folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session without one (tests) gets a folder under /tmp;
    any other session must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; concurrent and repeated runs never meet."""
    return f"{(_FOLDER.get() or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Paths made inside lie in a folder that goes when this ends. What is to stay is computed and stored before."""
    folder = fresh_path(spark, "scratch")
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        fs, path = file_system(folder)
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: lineage ends here, nothing is computed twice."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to and from Python in batches of at most BATCH_BYTES; a batch lies in memory several times, off the heap
    and in Python, for each running task."""
    if spark.conf.get(BATCH_CONF, None) != str(BATCH_BYTES):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def file_system(uri: str):
    """(file system, path) of a URI for code inside tasks."""
    from pyarrow import fs
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def as_text(df: DataFrame, column: str = "text"):
    """The column as a string, null as the empty text."""
    from pyspark.sql import functions as F
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_with_text(docs: DataFrame, text: str):
    """(columns, place of the text in `row`): each row whole as `row`. A text that is a string is sent once, within its row;
    any other is cast beside it, and its place is None."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType
    row = F.struct(*docs.columns).alias("row")
    if isinstance(docs.select(text).schema[0].dataType, StringType):
        return [row], [c.lower() for c in docs.columns].index(text.lower())
    return [as_text(docs, text).alias("text"), row], None


def text_of_row(batches: Iterator, place: int | None) -> Iterator:
    """Batches with the text of their rows as a column `text`, without a copy."""
    import pyarrow as pa
    for b in batches:
        yield b if place is None else pa.record_batch([*b.columns, b.column("row").field(place)], [*b.schema.names, "text"])
