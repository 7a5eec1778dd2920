"""Ingestion: deduplication against earlier batches, versions, caps, refresh and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut_lineage


def unseen(batch: DataFrame, seen: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text's hash is not in ``seen`` (hash). Copies within the batch are all kept."""
    return batch.withColumn("hash", F.md5(text_col)).join(seen.select("hash"), "hash", "left_anti")


def list_sources(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, n_docs) of each source; a null one is ``unknown``."""
    source = F.coalesce(source_col, F.lit("unknown"))
    return docs.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))


def source_versions(chunks: DataFrame, order_col: str, text_col: str = "text") -> DataFrame:
    """(source, content_hash, chunk_count). Each chunk's hash covers its place and text; a source's
    hash is that of their sums, so a source of any size is summed in the tasks and never gathered."""
    chunk = F.md5(F.concat_ws("|", F.col(order_col).cast("string"), F.col(text_col)))
    lanes = [
        F.sum(F.conv(F.substring(chunk, 1 + 8 * k, 8), 16, 10).cast("long")).cast("string")
        for k in range(4)
    ]
    return chunks.groupBy("source").agg(
        F.md5(F.concat_ws("-", *lanes)).alias("content_hash"), F.count(F.lit(1)).alias("chunk_count")
    )


def changed_sources(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources whose content hash differs from the stored one, or has none."""
    old = stored.select("source", F.col("content_hash").alias("old_hash"))
    return current.join(old, "source", "left").where(
        F.col("old_hash").isNull() | (F.col("old_hash") != F.col("content_hash"))
    )


def cap_per_source(chunks: DataFrame, most: int, order_col: str) -> DataFrame:
    """The first ``most`` chunks of each source; a feature, off at 0. Tasks limit before the shuffle."""
    if most <= 0:
        return chunks
    order = Window.partitionBy("source").orderBy(order_col)
    return chunks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def stale(sources: DataFrame, now: Column, days: float) -> DataFrame:
    """Sources ingested over ``days`` ago, with their age in days."""
    age = F.timestamp_diff("MICROSECOND", F.col("ingested_at"), now) / 86_400_000_000
    return sources.withColumn("age_days", F.round(age, 1)).where(age > days)


def namespaced(id_col: Column, namespace: str) -> Column:
    prefix = f"{namespace}_"
    return F.when(id_col.startswith(prefix), id_col).otherwise(F.concat(F.lit(prefix), id_col))


def purge(rows: DataFrame, gone: DataFrame, on: str = "source") -> DataFrame:
    return rows.join(gone.select(on).distinct(), on, "left_anti")


def prune_arrays(nodes: DataFrame, gone: DataFrame, array_col: str = "chunk_ids") -> DataFrame:
    """Removes deleted ids from an array column; rows left without any go.

    Ids are exploded and joined, so the deleted set may be of any size.
    """
    keys = [c for c in nodes.columns if c != array_col]
    left = (
        nodes.select(*keys, F.explode(array_col).alias("_id"))
        .join(gone.select(F.col("id").alias("_id")).distinct(), "_id", "left_anti")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_id")).alias(array_col))
    )
    return left.select(*nodes.columns)


def delete_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows without those whose id, or else whose source, is among ``ids`` (id)."""
    known = ids.join(rows.select("id"), "id", "left_semi")
    sources = ids.join(rows.select("id"), "id", "left_anti").select(F.col("id").alias("source"))
    return rows.join(known, "id", "left_anti").join(sources, "source", "left_anti")


def ingest_stats(chunks: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return chunks.agg(
        n.alias("n_chunks"),
        F.count_distinct("source").alias("n_sources"),
        (n - F.count_distinct("id")).alias("id_collisions"),
    )


def audit(events: DataFrame, since: Column | None = None, limit: int = 100, **equal: str) -> DataFrame:
    """Newest events first that equal the given columns; limit of 1 to 1000."""
    rows = events if since is None else events.where(F.col("ts") >= since)
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(min(max(limit, 1), 1000))


def audit_prune(events: DataFrame, now: Column, days: int) -> DataFrame:
    return events.where(F.col("ts") > now - F.expr(f"INTERVAL {int(days)} DAYS"))


def table_row_text(row_columns: list[str], title: str) -> Column:
    """A table row as text; empty and null cells are left out."""
    cells = []
    for name in row_columns:
        cell = F.col(f"`{name}`").cast("string")
        cells.append(F.when(F.trim(cell) != "", F.concat(F.lit(f"{name}: "), cell)))
    names = ", ".join(row_columns)
    return F.concat(F.lit(f"Context: {title} | Columns: [{names}] | Data: "), F.concat_ws(" | ", *cells))


def project_tree(projects: DataFrame, root: str, depth: int = 64) -> DataFrame:
    """(project) of all descendants of ``root`` in (project, parent); a cycle ends the walk."""
    found = frontier = cut_lineage(projects.where(F.col("parent") == root).select("project").distinct())
    for _ in range(depth):
        step = projects.join(frontier.withColumnRenamed("project", "parent"), "parent").select("project")
        frontier = cut_lineage(step.distinct().join(found, "project", "left_anti").where(F.col("project") != root))
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    return found
