"""Saved forms of what the operators make: folders of Parquet tables that are read back as they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], folder: str, by: dict[str, str] | None = None) -> None:
    """Writes each table to its folder, partitioned by the column that ``by`` names for it."""
    for name, frame in tables.items():
        writer = frame.write.mode("overwrite")
        key = (by or {}).get(name)
        (writer.partitionBy(key) if key else writer).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def text_payload(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> dict[str, DataFrame]:
    """``texts`` (t, text), each different text once, and ``docs`` (id, t), which point at them; t
    is the least id that has the text. Null counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = rows.groupBy("text").agg(F.min("id").alias("t"))
    return {"texts": texts.select("t", "text"), "docs": rows.join(texts, "text").select("id", "t")}


def whole_docs(payload: dict[str, DataFrame]) -> DataFrame:
    return payload["docs"].join(payload["texts"], "t").select("id", "text")


def shard_of(key: str, shards: int):
    """A shard's number by the hash of a key: the same in every run and engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(shards))


def changed_shards(relations: DataFrame, before: DataFrame, shards: int, key: str = "src") -> DataFrame:
    """The rows of ``relations`` whose shard differs from what it was ``before``: the shards that
    must be written again. A shard's signature is summed over its rows."""

    def signed(rows: DataFrame, name: str) -> DataFrame:
        columns = sorted(c for c in relations.columns)
        row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
        lanes = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("long")).cast("string") for k in range(4)]
        return rows.groupBy(shard_of(key, shards).alias("shard")).agg(F.concat_ws("-", *lanes).alias(name))

    both = signed(relations, "now").join(signed(before, "old"), "shard", "left")
    new = both.where(F.col("old").isNull() | (F.col("old") != F.col("now"))).select("shard")
    return relations.withColumn("shard", shard_of(key, shards)).join(F.broadcast(new), "shard")


def append_events(stored: DataFrame, batch: DataFrame, key: str = "event_id") -> DataFrame:
    """The rows of ``batch`` to append to an audit log: those whose key is not stored yet, one a key."""
    return batch.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(*stored.columns)


def snapshot(entities: DataFrame, facts: DataFrame, folder: str) -> None:
    """Exports what readers of a shared graph see: all entities, and the active facts."""
    save({"entities": entities, "facts": facts.where("status = 'active'")}, folder)
