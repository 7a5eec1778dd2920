"""Running totals within groups of any size: a hot group is spread over ranges of its order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut_lineage


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_range``: the partition they lie in when ranged by keys and order. It is
    checkpointed, so that a range stays the same when an executor is lost. Keep rows narrow."""
    return cut_lineage(rows.repartitionByRange(*keys, *order)).withColumn("_range", F.spark_partition_id())


def running(ranged: DataFrame, keys: list[str], order: list[str], name: str, amount: Column, kind: str = "sum") -> DataFrame:
    """Adds ``name``: the sum (or max) of ``amount`` from the first row of the same keys to this.

    Each range totals its own rows; the totals of a group's earlier ranges, one row for each range,
    are added. Null keys are one group; a null amount adds nothing; rows that tie in ``order``
    count one after another in no fixed order.
    """
    fold = {"sum": F.sum, "max": F.max}[kind]
    own = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", fold(amount).over(own))
    totals = ranged.groupBy("_range", *keys).agg(fold(amount).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    offsets = totals.select(F.col("_range").alias("_r"), *named, fold("_total").over(before).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = local.join(offsets, reduce(Column.__and__, same, F.col("_range") == F.col("_r")))
    if kind == "sum":
        whole = F.when(F.coalesce("_before", "_local").isNotNull(), F.coalesce("_before", F.lit(0)) + F.coalesce("_local", F.lit(0)))
    else:
        whole = F.greatest("_before", "_local")
    return joined.withColumn(name, whole).drop("_local", "_r", "_before", *[f"_k{i}" for i in range(len(keys))])
