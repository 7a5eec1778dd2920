"""Graph queries: entities in documents, and the graph of customers, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import graph
from skein.operators.batches import parts_of
from skein.operators.components import connected_components
from skein.plans.registry import registry, table

QUERIES, query = registry()

ENTITIES = r"""
m AS (
  SELECT doc_id AS chunk_id, list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '0', 'g'), '\b([A-Z][a-z]+(?:\s[A-Z][a-z]+){1,3})\b', 1), lambda n: regexp_replace(n, '\s', ' ', 'g')) AS names
  FROM documents
),
e AS (SELECT chunk_id, unnest(names) AS name, unnest(range(len(names))) AS i FROM m),
f AS (SELECT chunk_id, lower(name) AS k, arg_min(name, i) AS name, min(i) AS i FROM e GROUP BY 1, 2),
mentions AS (SELECT chunk_id, name FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS r FROM f) WHERE r <= 20)"""

#: An edge joins a customer's nation and a supplier that one of its orders used.
EDGES = """
relations AS (
  SELECT concat('c', c_nationkey) AS src, concat('s', l_suppkey) AS target, l_returnflag AS relation,
         l_quantity AS strength, l_orderkey AS chunk_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
merged AS (
  SELECT src, target, relation, sum(strength) AS weight, count(*) AS support_count, count(DISTINCT chunk_id) AS text_units
  FROM relations GROUP BY 1, 2, 3
)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation for each line, dealt by its order (the chunk), so that they are merged where they meet."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    parts = parts_of(lines)
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (
        lines.repartition(parts, "l_orderkey")
        .join(placed.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("src"),
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"),
            F.col("l_returnflag").alias("relation"),
            F.col("l_quantity").alias("strength"),
            F.col("l_orderkey").alias("chunk_id"),
        )
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.light_entities(table(spark, sf_dir, "documents"), id_col="doc_id")


@query(f"WITH {ENTITIES} SELECT chunk_id, name, 'CONCEPT' AS type FROM mentions")
def entities_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir)


@query(
    f"""WITH {ENTITIES} SELECT lower(trim(name)) AS entity, 'CONCEPT' AS type, count(DISTINCT chunk_id) AS frequency
FROM mentions GROUP BY 1"""
)
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_entities(mentions(spark, sf_dir))


@query(f"WITH {EDGES} SELECT * FROM merged")
def relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_relations(relations(spark, sf_dir))


@query(
    f"""WITH {EDGES}, ends AS (SELECT src AS entity, 1 AS o, 0 AS i FROM merged UNION ALL SELECT target, 0, 1 FROM merged)
SELECT entity, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) + sum(i) AS BIGINT) AS degree
FROM ends GROUP BY 1"""
)
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.merge_relations(relations(spark, sf_dir)))


#: Customers and suppliers, each linked to every order of theirs.
TRADE = """
edges AS (
  SELECT concat('o', o_orderkey) AS src, concat('c', o_custkey) AS dst FROM orders
  UNION SELECT concat('o', l_orderkey), concat('s', l_suppkey) FROM lineitem
)"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each order to its customer."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"),
    )


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each order to its customer and to each of its suppliers."""
    supplied = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
    )
    return order_edges(spark, sf_dir).union(supplied)


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer for each benchmark item."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("c"), (F.col("item_id") + 1).cast("string")).alias("node"),
    )


def walk_sql(edges: str, most: int) -> str:
    return f"""WITH RECURSIVE {edges},
undirected AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk(query_id, node, hop) AS (
  SELECT item_id, concat('c', item_id + 1), 0 FROM benchmark
  UNION
  SELECT query_id, b, hop + 1 FROM walk JOIN undirected ON node = a WHERE hop < {most}
)
SELECT query_id, node, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY 1, 2"""


@query(walk_sql(TRADE, 3))
def graph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders, their suppliers, and the orders of those."""
    return graph.hops(trade_edges(spark, sf_dir), seeds(spark, sf_dir), 3)


@query(walk_sql("edges AS (SELECT concat('o', o_orderkey) AS src, concat('c', o_custkey) AS dst FROM orders)", 3))
def graph_hops_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers alone, three steps far."""
    return graph.hops(order_edges(spark, sf_dir), seeds(spark, sf_dir), 3)


#: Links of orders to the next of the same customer within a hundred keys: many small components.
CHAINS = """
edges AS (
  SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders
)"""


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(order).alias("dst")
    )


@query(
    """WITH n AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS k,
  min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders)
SELECT o_orderkey AS node, component FROM n WHERE k > 1"""
)
def connected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(chain_edges(spark, sf_dir))


@query(
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id
  WHERE round(list_inner_product(a.e, b.e) / (a.n * b.n), 6) >= 0.4),
undirected AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
walk(node, other) AS (SELECT a, a FROM undirected UNION SELECT node, b FROM walk JOIN undirected ON other = a)
SELECT node, min(other) AS component FROM walk GROUP BY 1"""
)
def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return graph.alias_groups(rows, 0.4)


@query()
def community_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.merge_relations(relations(spark, sf_dir)).select("src", F.col("target").alias("dst"), "weight")
    return graph.communities(edges)


LABELS = "labels AS (SELECT concat('p', p_partkey) AS node, p_brand AS community FROM part)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("community")
    )


@query(
    f"""WITH {LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY node) AS n, count(*) OVER (PARTITION BY community) AS size FROM labels)
SELECT community, any_value(size) AS size, concat('A cluster of ', any_value(size), ' entities: ', string_agg(node, ', ' ORDER BY node) FILTER (WHERE n <= 5),
  CASE WHEN any_value(size) > 5 THEN concat(' (+', any_value(size) - 5, ' more)') ELSE '' END, '.') AS summary FROM r GROUP BY 1"""
)
def community_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_template(labels(spark, sf_dir))


@query(
    """WITH v AS (SELECT p_brand AS community, p_type AS parent, count(*) AS n FROM part GROUP BY 1, 2)
SELECT community, parent FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, parent) AS r FROM v) WHERE r = 1"""
)
def community_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_type").alias("community")
    )
    return graph.parent_communities(labels(spark, sf_dir), coarse)


def payload(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    merged = graph.merge_relations(relations(spark, sf_dir))
    nodes = graph.degrees(merged).select("entity", F.col("degree").alias("frequency"))
    return graph.graph_payload(nodes, merged)


@query(
    f"""WITH {EDGES}, ends AS (SELECT src AS entity FROM merged UNION ALL SELECT target FROM merged)
SELECT entity AS id, substring(entity, 1, 24) AS label, 4 + least(count(*), 18) AS val FROM ends GROUP BY 1"""
)
def graph_payload_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload(spark, sf_dir)[0]


@query(
    f"""WITH {EDGES} SELECT src AS source, target, relation, weight AS value, 1 + weight / 8 AS width FROM merged"""
)
def graph_payload_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload(spark, sf_dir)[1]


@query(
    """WITH q AS (SELECT item_id AS query_id, concat(lower(p_name), CASE WHEN item_id % 2 = 0 THEN ' blue' ELSE '' END) AS asked FROM benchmark JOIN part ON p_partkey = item_id),
e AS (SELECT DISTINCT lower(p_name) AS entity FROM part),
qt AS (SELECT query_id, asked, list_distinct(string_split(asked, ' ')) AS qt FROM q),
et AS (SELECT entity, list_distinct(list_filter(string_split_regex(entity, '\\s+'), lambda x: x <> '')) AS et FROM e),
s AS (SELECT query_id, entity, round(CASE WHEN asked = entity THEN 1 WHEN len(qt) = 1 AND len(et) = 1 THEN 0
  ELSE len(list_intersect(qt, et)) / len(list_distinct(list_concat(qt, et))) END, 6) AS score FROM qt JOIN et ON list_has_any(qt, et))
SELECT query_id, entity, max(score) AS score FROM s WHERE score >= 0.4 GROUP BY 1, 2"""
)
def entity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("item_id") % 2 == 0, " blue").otherwise("")
    items = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("item_id"))
    asked = items.select(F.col("item_id").alias("query_id"), F.concat(F.lower("p_name"), more).alias("name"))
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("entity")).distinct()
    return graph.entity_matches(asked, names)


BUDGET = """r AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS cost FROM orders)"""


def budget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query_id"),
        F.col("o_orderkey").alias("id"),
        F.row_number().over(order).alias("rank"),
        F.floor(F.col("o_totalprice") / 1000).alias("cost"),
    )


@query(
    f"""WITH {BUDGET}, s AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS spent FROM r)
SELECT query_id, id, spent FROM s WHERE spent <= 500"""
)
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prefix_budget(budget_rows(spark, sf_dir), 500, F.col("cost")).select("query_id", "id", "spent")


@query(
    f"""WITH RECURSIVE {BUDGET}, walk(query_id, rank, id, spent, taken) AS (
  SELECT query_id, rank, id, CASE WHEN cost <= 500 THEN cost ELSE 0 END, cost <= 500 FROM r WHERE rank = 1
  UNION ALL
  SELECT r.query_id, r.rank, r.id, CASE WHEN spent + cost <= 500 THEN spent + cost ELSE spent END, spent + cost <= 500
  FROM walk JOIN r ON r.query_id = walk.query_id AND r.rank = walk.rank + 1)
SELECT query_id, id FROM walk WHERE taken"""
)
def budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fill_budget(budget_rows(spark, sf_dir), 500)
