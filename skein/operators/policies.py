"""Which rows take part in which step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.routing import SOURCE_POLICY


def matches(filters: dict[str, object]) -> Column:
    """Equality of every given column: filters on columns reach the scan."""
    tests = [F.col(name).eqNullSafe(F.lit(value)) for name, value in filters.items()]
    return reduce(Column.__and__, tests, F.lit(True))


def eligible_sentences() -> Column:
    """Chunks that are split to sentences: no code, summaries or parents."""
    prose = F.coalesce("source_class", F.lit("")) != "code"
    return prose & ~F.coalesce("chunk_kind", F.lit("")).isin("raptor", "parent") & F.col("raptor_level").isNull()


def allowed(kind: Column, step: str) -> Column:
    """Whether a dataset type takes part in ``summaries`` or ``graph``."""
    place = ("summaries", "graph").index(step)
    barred = [name for name, flags in SOURCE_POLICY.items() if not flags[place]]
    return ~F.coalesce(kind, F.lit("")).isin(*barred)


def large_sources(chunks: DataFrame, least_mb: float) -> DataFrame:
    """Chunks of sources whose text is at least ``least_mb``; sums meet, texts do not move."""
    sizes = chunks.groupBy("source").agg(F.sum(F.length("text")).alias("_chars"))
    big = sizes.where(F.col("_chars") >= least_mb * 1024 * 1024).select("source")
    return chunks.join(big, "source", "left_semi")


def skip_leaves(chunks: DataFrame, threshold: int) -> DataFrame:
    """Sources of ``threshold`` or more leaves keep their summaries alone (raptor_level)."""
    leaf = F.col("raptor_level").isNull()
    many = chunks.where(leaf).groupBy("source").count().where(F.col("count") >= threshold).select("source")
    kept = chunks.where(leaf).join(many, "source", "left_anti")
    return kept.unionByName(chunks.where(~leaf))


def relation_chunks(chunks: DataFrame, entities: DataFrame, least: int = 3, budget: int = 0) -> DataFrame:
    """Chunks of at least ``least`` entities; with a budget, those with most entities a character."""
    counts = entities.groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("n_entities"))
    fit = chunks.join(counts.where(F.col("n_entities") >= least), "id")
    if budget <= 0:
        return fit
    density = F.col("n_entities") / F.greatest(F.length("text"), F.lit(1))
    return fit.orderBy(F.desc(density), "id").limit(budget)


def frequent_entities(entities: DataFrame, relations: DataFrame, least: int = 2) -> DataFrame:
    """(entity): those of at least ``least`` mentions, and both ends of every relation."""
    often = entities.where(F.col("frequency") >= least).select("entity")
    ends = relations.select(F.col("src").alias("entity")).union(relations.select("target"))
    return often.union(ends).distinct()


def over_fetch(k: int, rerank: bool, hybrid: bool, code_factor: int = 1) -> int:
    """Candidates to fetch for ``k`` results."""
    return k * (3 if rerank or hybrid else 1) * code_factor


def conflicting_descriptions(mentions: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """(entity, descriptions) with several and at least ``least`` descriptions, ``most`` at most of
    them in order of their chunk, for a model to unify."""
    spoken = mentions.where(F.coalesce("description", F.lit("")) != "")
    firsts = spoken.groupBy("entity", "description").agg(F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("entity").orderBy("chunk_id", "description")
    few = firsts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    listed = few.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("_n", "description"))).alias("d"))
    enough = firsts.groupBy("entity").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m"))
    chosen = enough.where((F.col("k") > 1) & (F.col("m") >= least))
    return listed.join(chosen, "entity").select("entity", F.transform("d", lambda x: x["description"]).alias("descriptions"))


def unextracted(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks (id, ...) that no entity was taken from yet."""
    return chunks.join(mentions.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")


# fixed values: relation types that are known from the start
RELATIONS = (
    "WORKS_FOR", "KNOWS", "LOCATED_IN", "PART_OF", "OWNS", "CREATED_BY", "RELATED_TO", "CAUSES", "IS_A", "HAS",
    "MENTIONS", "CONTRADICTS",
)


def known_relation(relation: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a relation type is registered, in any case."""
    return F.upper(relation).isin(*RELATIONS, *[e.upper() for e in extra])


def relation_types(relations: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(relation, n, known): the types in use and those registered, with their numbers of uses."""
    used = relations.groupBy(F.upper("relation").alias("relation")).agg(F.count(F.lit(1)).alias("n"))
    listed = sorted({*RELATIONS, *[e.upper() for e in extra]})
    registered = relations.sparkSession.createDataFrame([(r,) for r in listed], "relation string")
    joined = used.join(registered.withColumn("known", F.lit(True)), "relation", "full")
    return joined.select("relation", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("known", F.lit(False)).alias("known"))
