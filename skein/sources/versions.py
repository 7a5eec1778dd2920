"""Versions of a stored folder: what is current is told by the last complete manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """Lists of numbered parts of a folder. A version is one small table, written whole before readers
    see it, so a writer that is lost leaves the version before. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, f"{folder}/manifest", schema

    def last(self) -> tuple[int, list]:
        """The last version's number, 0 before the first, and its rows."""
        try:
            rows = self.spark.read.schema(f"{self.schema}, version int").parquet(self.folder)
            version = rows.agg(F.max("version")).first()[0]
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []
        return (0, []) if version is None else (version, rows.where(F.col("version") == version).drop("version").collect())

    def put(self, version: int, rows: list) -> None:
        frame = self.spark.createDataFrame(rows, self.schema)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/version={version}")


def parts(spark: SparkSession, folder: str, numbers: list[int], kind: str, schema: str) -> DataFrame:
    """The tables ``kind`` of the given generations, with their number as ``generation``."""
    found = None
    for number in numbers:
        rows = spark.read.schema(schema).parquet(f"{folder}/generation={number}/{kind}").withColumn("generation", F.lit(number))
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], f"{schema}, generation int") if found is None else found


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark reads; one that is not there is no error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
