"""A store of bi-temporal facts that takes them in any order, by scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.facts import succession, valid_at
from skein.session import cut_lineage
from skein.sources.versions import Manifest, remove_folder

#: In the manifest, the row that tells the last stream batch that was taken.
BATCH = -1


class FactStore:
    """Facts (fact_id, scope_key, valid_at, ...) with invalid_at and status, filed by the hash of scope.

    ``upsert`` takes facts in any order. It reads the buckets of the scopes that come, derives the
    succession of those scopes anew from all their facts, and writes the buckets as a generation; the
    manifest then names, for each bucket, the generation that holds it. A late fact so closes the
    ones before it, shortens an interval that was closed later, or reopens what its removal from the
    end leaves open, and the store equals the batch ``succession`` of all facts whatever the order of
    arrival. Open and conflicted facts are given out like others. Scopes of other facts are copied,
    not derived.

    A scope and a fact_id name a fact: one that comes again replaces the earlier, and of rows that
    repeat it within one batch the one with the latest valid_at counts. Facts without a scope stay
    active and are filed by their id. A null fact_id is one fact of its scope. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32, tie_seconds: float = 1.0):
        self.spark, self.folder, self.buckets, self.tie = spark, folder, buckets, tie_seconds
        self.manifest = Manifest(spark, folder, "bucket int, generation long")

    def bucket(self) -> Column:
        filed = F.coalesce(F.col("scope_key").cast("string"), F.concat(F.lit("id:"), F.col("fact_id").cast("string")))
        return F.pmod(F.xxhash64(filed), F.lit(self.buckets)).cast("int")

    def held(self) -> tuple[int, dict[int, int]]:
        version, rows = self.manifest.last()
        return version, {r.bucket: r.generation for r in rows}

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The facts of all buckets or of some; None where there are none."""
        held = self.held()[1]
        named = [b for b in sorted(held) if b != BATCH and (buckets is None or b in buckets)]
        if not named:
            return None
        paths = [f"{self.folder}/generation={held[b]}/bucket={b}" for b in named]
        return self.spark.read.option("basePath", self.folder).parquet(*paths).drop("generation", "bucket")

    def upsert(self, facts: DataFrame, batch: int | None = None) -> None:
        """Takes facts. ``batch`` is a stream's number: one that was taken before changes nothing."""
        version, held = self.held()
        if batch is not None and batch <= held.get(BATCH, -1):
            return
        columns = facts.columns
        new = cut_lineage(facts.withColumn("_turn", F.lit(1)))
        touched = [r.b for r in new.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        if touched:
            old = self.read(touched)
            came = new.select("scope_key").where("scope_key IS NOT NULL").distinct()
            rows, kept = new, None
            if old is not None:
                again = old.join(came, "scope_key", "left_semi").unionByName(old.where("scope_key IS NULL"))
                rows = again.select(*columns, F.lit(0).alias("_turn")).unionByName(new)
                kept = old.where("scope_key IS NOT NULL").join(came, "scope_key", "left_anti")
            whole = F.struct(*columns)
            last = F.struct("_turn", "valid_at", F.xxhash64(*columns).alias("h"))
            rows = rows.groupBy("scope_key", "fact_id").agg(F.max_by(whole, last).alias("fact")).select("fact.*")
            done = succession(rows, self.tie)
            done = done if kept is None else done.unionByName(kept)
            filed = done.withColumn("bucket", self.bucket())
            filed.repartition("bucket", F.xxhash64("scope_key")).write.mode("overwrite").partitionBy("bucket").parquet(
                f"{self.folder}/generation={version + 1}"
            )
        held |= dict.fromkeys(touched, version + 1)
        if batch is not None:
            held[BATCH] = batch
        self.manifest.put(version + 1, sorted(held.items()))

    def at(self, when: Column) -> DataFrame | None:
        """The facts that hold at an instant (microseconds since 1970)."""
        rows = self.read()
        return None if rows is None else rows.where(valid_at(when))

    def clear(self) -> None:
        """Deletes the folders of generations that hold no bucket any more."""
        version, held = self.held()
        for number in set(range(1, version + 1)) - {g for b, g in held.items() if b != BATCH}:
            remove_folder(self.spark, f"{self.folder}/generation={number}")


def upsert_stream(stream: DataFrame, store: FactStore, checkpoint: str) -> StreamingQuery:
    """Takes each micro-batch of a stream of facts into a store, once however often it is repeated."""
    return (
        stream.writeStream.foreachBatch(lambda rows, number: store.upsert(rows, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
