"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of one Arrow batch handed to Python; texts may be long, so batches stay short.
ARROW_ROWS = 1000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same on pure ASCII and is much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker: few rows at a time cross to it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh_name(frame: DataFrame, name: str) -> str:
    """``name``, longer if the frame has a column of that name."""
    while name in frame.columns:
        name += "_"
    return name


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that have one of ``names`` under names of their own, and what each
    column is called now. So an operator can add columns of these names and give the input's back:
    see ``put_back``. Other columns keep their names."""
    called = {c: c for c in docs.columns}
    for c in docs.columns:
        if c in names:
            new = f"_aside_{c}"
            while new in docs.columns or new in names:
                new += "_"
            called[c] = new
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in called.items()]), called


def put_back(frame: DataFrame, called: dict[str, str]) -> DataFrame:
    """The input's columns alone, under their own names."""
    return frame.select(*[F.col(f"`{n}`").alias(c) for c, n in called.items()])
