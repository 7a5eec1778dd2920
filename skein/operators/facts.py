"""Bi-temporal facts: succession within a scope, conflicts, point-in-time lookup, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import html_escape, relation_words
from skein.operators.graph import hops


def micros(when: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), when.cast("timestamp_ntz"))


def succession(facts: DataFrame, tie_seconds: float = 1.0) -> DataFrame:
    """Adds invalid_at and status to facts (fact_id, scope_key, valid_at, ...).

    Within a scope a later fact closes the ones before it: a fact with a successor over
    ``tie_seconds`` later is superseded from then on; of facts within that time none closes the
    other, both are conflicted. Facts without a scope stay active and take no part in a window.
    Later facts are looked at from the end of a scope, so that each window only grows.
    """
    at, tie = F.col("_us"), int(tie_seconds * 1_000_000)
    rows = facts.where("scope_key IS NOT NULL").withColumn("_us", micros(F.col("valid_at")))
    backwards = Window.partitionBy("scope_key").orderBy(F.desc("_us"))
    later = backwards.rangeBetween(Window.unboundedPreceding, -(tie + 1))
    order = Window.partitionBy("scope_key").orderBy("_us", "fact_id")
    near = ((at - F.lag("_us").over(order)) <= tie) | ((F.lead("_us").over(order) - at) <= tie)
    scoped = rows.select(
        "*",
        F.min("valid_at").over(later).alias("_closed"),
        F.coalesce(near, F.lit(False)).alias("_near"),
        F.max("valid_at").over(Window.partitionBy("scope_key")).alias("_last"),
    )
    closed = F.col("_closed").isNotNull()
    status = F.when(closed, "superseded").when(F.col("_near"), "conflicted").otherwise("active")
    until = F.when(closed, F.col("_closed")).when(F.col("_near"), F.col("_last"))
    done = scoped.withColumn("status", status).withColumn("invalid_at", until)
    free = facts.where("scope_key IS NULL").withColumn("status", F.lit("active"))
    free = free.withColumn("invalid_at", F.lit(None).cast(facts.schema["valid_at"].dataType))
    return done.drop("_us", "_closed", "_near", "_last").unionByName(free)


def valid_at(when: Column) -> Column:
    """Facts that hold at an instant (microseconds since 1970); superseded ones are left out."""
    open_end = F.col("invalid_at").isNull() | (micros(F.col("invalid_at")) > when)
    return (micros(F.col("valid_at")) <= when) & open_end & (F.col("status") != "superseded")


def conflicts(facts: DataFrame, limit: int = 100) -> DataFrame:
    return facts.where("status = 'conflicted'").orderBy(F.desc("valid_at"), F.desc("fact_id")).limit(limit)


def status_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def orphans(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts without evidence become superseded."""
    kept = evidence.select("fact_id", F.lit(True).alias("_kept")).distinct()
    status = F.when(F.col("_kept"), F.col("status")).otherwise(F.lit("superseded"))
    return facts.join(kept, "fact_id", "left").withColumn("status", status).drop("_kept")


def retrieve(facts: DataFrame, seeds: DataFrame, most: int = 1, decay: float = 0.7) -> DataFrame:
    """(query_id, fact_id, hop, score) of active facts around seeds (query_id, node): a fact has
    the hop of the nearer end that it was reached from, and scores confidence * decay**hop."""
    active = facts.where("status = 'active'")
    edges = active.select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    reached = hops(edges, seeds, most - 1) if most > 1 else seeds.withColumn("hop", F.lit(0))
    ends = active.select("fact_id", "confidence", F.col("subject").alias("node")).union(
        active.select("fact_id", "confidence", F.col("object"))
    )
    near = reached.join(ends, "node").groupBy("query_id", "fact_id").agg(
        F.min("hop").alias("hop"), F.max("confidence").alias("confidence")
    )
    score = F.col("confidence") * F.pow(F.lit(decay), F.col("hop"))
    return near.select("query_id", "fact_id", "hop", F.round(score, 6).alias("score"))


def pair_weights(facts: DataFrame) -> DataFrame:
    """(u, v, weight, distance) of unordered pairs: confidences summed."""
    ends = facts.select(
        F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v"), "confidence"
    )
    summed = ends.groupBy("u", "v").agg(F.round(F.sum("confidence"), 6).alias("weight"))
    return summed.withColumn("distance", F.round(1 / (F.col("weight") + 1e-6), 6))


def fact_payload(facts: DataFrame, entities: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type, tooltip) and links (source, target, label, relation, value, width) of
    the ``limit`` surest active facts, a viewer's limit; ties go to the smaller fact_id.

    ``entities`` has (entity, type, description); others are UNKNOWN.
    """
    best = facts.where("status = 'active'").orderBy(F.desc("confidence"), "fact_id").limit(limit)
    day = F.substring(F.col("valid_at").cast("string"), 1, 10)
    label = F.concat(relation_words(F.col("relation")), F.coalesce(F.concat(F.lit(" ("), day, F.lit(")")), F.lit("")))
    links = best.select(
        F.col("subject").alias("source"),
        F.col("object").alias("target"),
        label.alias("label"),
        "relation",
        F.col("confidence").alias("value"),
        (1 + F.col("confidence")).alias("width"),
    )
    ends = best.select(F.col("subject").alias("id")).union(best.select("object")).distinct()
    told = ends.join(entities.withColumnRenamed("entity", "id"), "id", "left")
    text = F.coalesce("description", F.lit(""))
    tooltip = F.concat(F.lit("<b>"), html_escape(F.col("id")), F.lit("</b><br/>"), html_escape(F.substring(text, 1, 220)))
    nodes = told.select("id", F.substring("id", 1, 24).alias("label"), F.coalesce("type", F.lit("UNKNOWN")).alias("type"), tooltip.alias("tooltip"))
    return nodes, links


def fact_texts(facts: DataFrame) -> DataFrame:
    """(fact_id, text): a fact as a sentence for a context."""
    return facts.select("fact_id", F.concat_ws(" ", "subject", relation_words(F.col("relation")), "object").alias("text"))
