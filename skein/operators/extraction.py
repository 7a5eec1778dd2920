"""Records from a model's lines, aliases applied to a graph, graphs of several backends merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: relations of which a subject has one object at a time; their facts have a scope
EXCLUSIVE = (
    "IS_CEO_OF", "IS_CTO_OF", "IS_CFO_OF", "LEADS", "HEADQUARTERS_IN", "CURRENTLY_LIVES_IN", "MARRIED_TO",
    "CURRENT_VERSION",
)


def fields(lines: DataFrame, least: int, most: int) -> DataFrame:
    """(chunk_id, pos, p): the first ``most`` lines of (chunk_id, output) with ``least`` or more
    fields between ``|``, trimmed."""
    rows = lines.select("chunk_id", F.posexplode(F.split("output", "\n")).alias("pos", "line"))
    parts = F.transform(F.split("line", r"\|"), lambda p: F.trim(p))
    rows = rows.withColumn("p", parts).where(F.size("p") >= least)
    order = Window.partitionBy("chunk_id").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n", "line")


def part(k: int) -> Column:
    return F.get("p", F.lit(k))


def parse_claims(lines: DataFrame, most: int = 10) -> DataFrame:
    """``subject | object | type | status | description [| start | end | source]`` lines; dates
    that are none are null, a status other than TRUE or FALSE is SUSPECTED."""
    status = F.upper(part(3))
    return fields(lines, 5, most).select(
        "chunk_id",
        F.lower(part(0)).alias("subject"),
        F.lower(part(1)).alias("object"),
        part(2).alias("type"),
        F.when(status.isin("TRUE", "FALSE"), status).otherwise("SUSPECTED").alias("status"),
        part(4).alias("description"),
        F.expr("try_cast(get(p, 5) AS DATE)").alias("start_date"),
        F.expr("try_cast(get(p, 6) AS DATE)").alias("end_date"),
        F.nullif(part(7), F.lit("none")).alias("source_text"),
    )


def parse_facts(lines: DataFrame, most: int = 20) -> DataFrame:
    """``subject | relation | object [| confidence of 10]`` lines to facts; relations in upper snake
    case, confidence 0 to 1 (1 if missing), a scope for exclusive relations."""
    relation = F.upper(F.regexp_replace(part(1), r"[^0-9A-Za-z]+", "_"))
    tenth = F.expr("try_cast(get(p, 3) AS DOUBLE)") / 10
    subject = F.lower(part(0))
    return fields(lines, 3, most).select(
        "chunk_id",
        subject.alias("subject"),
        relation.alias("relation"),
        F.lower(part(2)).alias("object"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(tenth, F.lit(1.0)))).alias("confidence"),
        F.when(relation.isin(*EXCLUSIVE), F.concat_ws(":", subject, relation)).alias("scope_key"),
    )


def canonical_names(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, canonical): of each alias group (node, component) the entity of most chunks (ties:
    the least name) stands for all."""
    sized = groups.join(entities.select(F.col("entity").alias("node"), "frequency"), "node")
    order = Window.partitionBy("component").orderBy(F.desc("frequency"), "node")
    heads = sized.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("component", F.col("node").alias("canonical"))
    return groups.join(heads, "component").select(F.col("node").alias("entity"), "canonical")


def apply_aliases(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with both ends canonical; those that become loops go."""
    a = names.select(F.col("entity").alias("src"), F.col("canonical").alias("_src"))
    b = names.select(F.col("entity").alias("target"), F.col("canonical").alias("_target"))
    joined = relations.join(a, "src", "left").join(b, "target", "left")
    out = joined.withColumn("src", F.coalesce("_src", "src")).withColumn("target", F.coalesce("_target", "target"))
    return out.where("src <> target").select(*relations.columns)


def merge_backends(nodes: dict[str, DataFrame], links: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes of several backends, the first backend's for each id, and all links, tagged."""
    tagged = [f.withColumn("backend", F.lit(n)).withColumn("_o", F.lit(i)) for i, (n, f) in enumerate(nodes.items())]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = Window.partitionBy("id").orderBy("_o")
    kept = union.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_o")
    all_links = [f.withColumn("backend", F.lit(n)) for n, f in links.items()]
    return kept, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), all_links)


def mutual_support(relations: DataFrame, selected: DataFrame) -> DataFrame:
    """(target, support): how many selected entities (entity) point at a target."""
    own = relations.join(selected.select(F.col("entity").alias("src")).distinct(), "src", "left_semi")
    return own.groupBy("target").agg(F.count_distinct("src").alias("support"))


def top_relations(relations: DataFrame, selected: DataFrame, outward: int = 3, inward: int = 2) -> DataFrame:
    """The heaviest relations out of and into each selected entity."""
    chosen = selected.select("entity").distinct()
    out = relations.join(chosen.withColumnRenamed("entity", "src"), "src", "left_semi").withColumn("entity", F.col("src"))
    into = relations.join(chosen.withColumnRenamed("entity", "target"), "target", "left_semi").withColumn("entity", F.col("target"))

    def best(rows: DataFrame, n: int, way: str) -> DataFrame:
        order = Window.partitionBy("entity").orderBy(F.desc("weight"), "src", "target", "relation")
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        return ranked.withColumn("way", F.lit(way))

    return best(out, outward, "out").unionByName(best(into, inward, "in"))


def local_context(parts: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Candidates of several kinds (query_id, id, score, text) in one order: score times the
    kind's weight. The token budget is filled from it by ``graph.fill_budget``."""
    rows = [
        f.select("query_id", "id", "text", (F.col("score") * F.lit(float(weights.get(k, 1.0)))).alias("score")).withColumn("kind", F.lit(k))
        for k, f in parts.items()
    ]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "kind", "id")
    union = reduce(DataFrame.unionByName, rows)
    return union.withColumn("rank", F.row_number().over(order)).withColumn("cost", F.floor(F.length("text") / 4))
