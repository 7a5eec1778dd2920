"""Streaming forms: deduplicated ingestion, a delta log with compaction, keyed fact upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.ingest import unseen


def deduplicated(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Each text's first row only; state is one hash a text."""
    return stream.withColumn("hash", F.md5(text_col)).dropDuplicates(["hash"])


def windowed_dedup(stream: DataFrame, key: str, ts: str, keep: str = "1 hour") -> DataFrame:
    """First row of a key within ``keep``; older state goes with the watermark."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def ingest_stream(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's unseen rows to the Parquet folder ``store``.

    A batch goes to its own folder by number, so one that is repeated after a failure replaces
    what it wrote. Copies within a batch are all kept, like in a batch ingest.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = stored(spark, store, before=number)
        fresh = batch.withColumn("hash", F.md5("text")) if seen is None else unseen(batch, seen)
        fresh.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored(spark: SparkSession, store: str, before: int | None = None) -> DataFrame | None:
    """All batches of a store, or those before a number; None where there is nothing yet."""
    try:
        rows = spark.read.option("basePath", store).parquet(store)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows if before is None else rows.where(F.col("batch") < before)


def compact(spark: SparkSession, store: str, into: str) -> None:
    """Rewrites a store of many small batches as one folder of large files."""
    rows = stored(spark, store)
    if rows is not None:
        rows.drop("batch").write.mode("overwrite").parquet(f"{into}/batch=0")


def upsert_facts(stream: DataFrame, tie_seconds: float = 1.0) -> DataFrame:
    """Closes facts as later ones of their scope arrive: (scope_key, fact_id, valid_at, invalid_at,
    status). ``stream`` has (scope_key, fact_id, valid_at), in order of valid_at within a scope.

    State is a scope's last fact. A fact is given out when a later one decides on it: superseded
    if that is over ``tie_seconds`` later, else both are conflicted.
    """

    def step(key, batches, state):
        last = state.get if state.exists else None
        out = []
        # a scope's new facts may come in several pieces: they are ordered together
        arrived = pd.concat(list(batches), ignore_index=True)
        for row in arrived.sort_values(["valid_at", "fact_id"]).itertuples(index=False):
            at = row.valid_at.as_unit("us").value
            if last is not None:
                tied = at - last[1] <= tie_seconds * 1e6
                status = "conflicted" if tied or last[2] else "superseded"
                out.append((key[0], last[0], pd.Timestamp(last[1], unit="us"), row.valid_at, status))
                last = (int(row.fact_id), at, tied)
            else:
                last = (int(row.fact_id), at, False)
        if last is not None:
            state.update(last)
        columns = ["scope_key", "fact_id", "valid_at", "invalid_at", "status"]
        yield pd.DataFrame(out, columns=columns)

    return stream.groupBy("scope_key").applyInPandasWithState(
        step,
        "scope_key string, fact_id long, valid_at timestamp, invalid_at timestamp, status string",
        "fact_id long, us long, tied boolean",
        "append",
        "NoTimeout",
    )


def event_windows(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events in tumbling windows, by type (an extension)."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    )
