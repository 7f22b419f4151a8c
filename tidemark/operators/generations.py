"""Tables whose slices are replaced as a whole while others read them.

A slice is a (device, run, epoch). Its rows lie under the generation that wrote them, `data/generation=g/...`; which
generation a slice is read from stands in a log of switches, one file a swap. A swap writes the new rows of all its
slices first and then that one file, which appears at once, so a reader finds a slice before or after, never both or
neither. A job that dies in between leaves rows that no switch names; its repetition overwrites them. One writer at a
time; readers need no lock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .audio import EPOCH

SWITCH = "device_id string, run_id string, epoch bigint, generation bigint, empty boolean"


@dataclass(frozen=True)
class Generations:
    """A table of slices in the folder `path`; `columns` is the schema of its rows as DDL, with EPOCH first."""

    path: str
    columns: str

    def _read(self, spark: SparkSession, part: str, ddl: str, *inside: str) -> DataFrame:
        """A part of the table as of now, as files or folders by name: Spark takes two readings of one path in one plan for the same."""
        root = f"{self.path}/{part}"
        try:
            read = spark.read.schema(ddl).option("basePath", root)
            files = [f"{root}/{x}" for x in inside] or read.parquet(root).inputFiles()
            return read.parquet(*files) if files else spark.createDataFrame([], ddl)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], ddl)

    def switches(self, spark: SparkSession) -> DataFrame:
        """(EPOCH, generation, empty): the generation that each slice is read from."""
        log = self._read(spark, "switch", SWITCH)
        return log.groupBy(*EPOCH).agg(F.max("generation").alias("generation"), F.max_by("empty", "generation").alias("empty"))

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of all slices as of now, with `generation`. Only generations that a slice is read from are scanned;
        their numbers, one a swap at most, pass the driver."""
        now = self.switches(spark).where("not empty").drop("empty")
        live = [r[0] for r in now.select("generation").distinct().collect()]
        ddl = f"{self.columns}, generation bigint"
        if not live:
            return spark.createDataFrame([], ddl)
        return self._read(spark, "data", ddl, *(f"generation={g}" for g in sorted(live))).join(now, [*EPOCH, "generation"], "left_semi")

    def swapped(self, spark: SparkSession, generation: int) -> bool:
        return not self._read(spark, "switch", SWITCH).where(F.col("generation") == generation).isEmpty()

    def next_generation(self, spark: SparkSession) -> int:
        return (self._read(spark, "switch", SWITCH).agg(F.max("generation")).first()[0] or 0) + 1

    def write(self, rows: DataFrame, generation: int) -> None:
        """The rows of a generation; what a dead job left of it goes."""
        names = [c.split()[0] for c in self.columns.split(", ")]
        (rows.select(*names, F.lit(generation).cast("bigint").alias("generation")).repartition(*EPOCH)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(f"{self.path}/data"))

    def switch(self, slices: DataFrame, generation: int) -> None:
        """Read `slices` (EPOCH) from `generation` from now on, all of them at once: the log grows by one file."""
        spark = slices.sparkSession
        here = self._read(spark, "data", f"{self.columns}, generation bigint", f"generation={generation}").select(*EPOCH).distinct()
        said = slices.select(*EPOCH).distinct().join(here.withColumn("_has", F.lit(True)), EPOCH, "left")
        (said.select(*EPOCH, F.lit(generation).cast("bigint").alias("generation"), F.col("_has").isNull().alias("empty"))
         .coalesce(1).write.mode("append").parquet(f"{self.path}/switch"))

    def swap(self, slices: DataFrame, rows: DataFrame, generation: int) -> None:
        """Replace `slices` by `rows` (all rows of these slices, none for a slice that is empty now). Repeating a swap of
        one generation changes nothing once it was switched, so a replayed batch is harmless."""
        if self.swapped(slices.sparkSession, generation):
            return
        self.write(rows, generation)
        self.switch(slices, generation)
