"""Records from model output, saved forms, facts and communities, readers over written files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import extraction, graph, policies, search, windows
from skein.operators import facts as fact_ops
from skein.plans import facts as fact_plans
from skein.plans.facts import FACTS
from skein.plans.graphs import EDGES, ENTITIES, mentions, relations
from skein.plans.ranking import INDEX, asked
from skein.plans.registry import registry, table
from skein.session import ensure_checkpoint_dir
from skein.sources import readers, stores

QUERIES, query = registry()


def folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"


# Lines of a model: parts as chunks, three lines each, one of them malformed.
LINES = """lines AS (SELECT p_partkey AS chunk_id, p_name, p_brand, p_type, p_size FROM part)"""


def lines(spark: SparkSession, sf_dir: str, *parts) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("p_") else F.col(p).cast("string") for p in parts]).alias("output"))


@query(
    f"""WITH {LINES} SELECT chunk_id, p_name AS name, upper(p_type) AS type, concat('of ', p_brand) AS description FROM lines
UNION ALL SELECT chunk_id, p_brand, 'BRAND', '' FROM lines"""
)
def parsed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.parse_entities(lines(spark, sf_dir, "p_name", " | ", "p_type", " | of ", "p_brand", "\nno fields\n | X | y\n", "p_brand", " | brand"))


@query(
    f"""WITH {LINES} SELECT chunk_id, lower(p_name) AS src, 'MADE_BY' AS relation, lower(p_brand) AS target, 'as said' AS description, CAST(least(10, greatest(1, p_size)) AS DOUBLE) AS strength FROM lines
UNION ALL SELECT chunk_id, lower(p_brand), 'HAS', lower(p_type), '', CAST(5 AS DOUBLE) FROM lines"""
)
def parsed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.parse_relations(lines(spark, sf_dir, "p_name", " | MADE_BY | ", "p_brand", " | as said | ", "p_size", "\nonly | two\n", "p_brand", " | HAS | ", "p_type"))


@query(
    f"""WITH {LINES} SELECT chunk_id, lower(p_name) AS subject, lower(p_brand) AS object, 'MADE' AS type, 'TRUE' AS status, 'it is' AS description,
  '2020-01-02' AS start_date, CAST(NULL AS VARCHAR) AS end_date, CAST(NULL AS VARCHAR) AS source_text FROM lines
UNION ALL SELECT chunk_id, lower(p_brand), lower(p_type), 'HAS', 'SUSPECTED', 'may be', NULL, NULL, 'page 3' FROM lines"""
)
def parsed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.parse_claims(
        lines(spark, sf_dir, "p_name", " | ", "p_brand", " | MADE | true | it is | 2020-01-02 | never | none\nshort | line\n", "p_brand", " | ", "p_type", " | HAS | maybe | may be | | | page 3")
    )
    return found.withColumn("start_date", F.col("start_date").cast("string")).withColumn("end_date", F.col("end_date").cast("string"))


@query(
    f"""WITH {LINES} SELECT chunk_id, lower(p_name) AS subject, 'IS_CEO_OF' AS relation, lower(p_brand) AS object, round(least(1, p_size / 10), 6) AS confidence,
  concat(lower(p_name), ':IS_CEO_OF') AS scope_key FROM lines
UNION ALL SELECT chunk_id, lower(p_brand), 'MADE_OF', lower(p_type), CAST(1 AS DOUBLE), NULL FROM lines"""
)
def parsed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.parse_facts(lines(spark, sf_dir, "p_name", " | is ceo of | ", "p_brand", " | ", "p_size", "\nonly | two\n", "p_brand", " | made-of | ", "p_type"))
    return rows.withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {ENTITIES}, known AS (SELECT lower(trim(name)) AS entity, 'CONCEPT' AS type, count(DISTINCT chunk_id) AS frequency FROM mentions GROUP BY 1),
ends AS (SELECT p_brand AS entity FROM part UNION SELECT p_type FROM part)
SELECT * FROM known UNION ALL SELECT entity, 'UNKNOWN', 0 FROM ends WHERE entity NOT IN (SELECT entity FROM known)"""
)
def stub_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("target"))
    return graph.with_stub_nodes(graph.merge_entities(mentions(spark, sf_dir)), rows)


# The parts' names are linked to their brand; brand and type are two levels of communities.
LABELS = """labels AS (SELECT 0 AS level, p_brand AS community, concat('p', p_partkey) AS node FROM part
  UNION ALL SELECT 1, p_type, concat('p', p_partkey) FROM part)"""
#: Links of parts of one brand and size, in a chain.
LINKS = """links AS (SELECT concat('p', p_partkey) AS src, concat('p', lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey)) AS dst FROM part),
inner_links AS (SELECT src, dst FROM links WHERE dst <> 'p')"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node")
    part = table(spark, sf_dir, "part")
    fine = part.select(F.lit(0).alias("level"), F.col("p_brand").alias("community"), node)
    return fine.union(part.select(F.lit(1), F.col("p_type"), node))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    after = F.lead("p_partkey").over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), after.alias("b")).where("b IS NOT NULL")
    return rows.select(*[F.concat(F.lit("p"), F.col(c).cast("string")).alias(n) for c, n in (("a", "src"), ("b", "dst"))])


@query(
    f"""WITH {LABELS}, {LINKS}, c AS (SELECT node, community FROM labels WHERE level = 0),
i AS (SELECT a.community, count(*) AS internal_edges FROM inner_links JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE a.community = b.community GROUP BY 1)
SELECT community, count(*) AS size, coalesce(any_value(internal_edges), 0) AS internal_edges FROM c LEFT JOIN i USING (community) GROUP BY 1"""
)
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_sizes(labels(spark, sf_dir).where("level = 0").drop("level"), links(spark, sf_dir))


@query(
    f"""WITH {LABELS}, s AS (SELECT level, community, count(*) AS size FROM labels GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT level, community, size, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY size DESC, community) AS rank FROM s) WHERE rank <= 4"""
)
def top_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = labels(spark, sf_dir).groupBy("level", "community").agg(F.count(F.lit(1)).alias("size"))
    return graph.top_communities(sizes, most=4)


LANES = ", '-', ".join(f"CAST(sum(('0x' || substr(md5(node), {1 + 8 * k}, 8))::BIGINT) AS VARCHAR)" for k in range(4))


@query(f"WITH {LABELS} SELECT level, community, count(*) AS size, md5(concat(level, '|', {LANES})) AS member_hash FROM labels GROUP BY 1, 2")
def member_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.member_hash(labels(spark, sf_dir))


@query(
    """WITH n AS (SELECT o_custkey, min(o_orderkey) AS least, count(*) AS k FROM orders GROUP BY 1),
top AS (SELECT o_custkey FROM n ORDER BY k DESC, least LIMIT 1)
SELECT src, dst FROM (SELECT o_custkey, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders) JOIN top USING (o_custkey)"""
)
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.plans.graphs import chain_edges

    return graph.largest_component(chain_edges(spark, sf_dir))


@query()
def nested_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts by brand and size, split until small; held against their rules in the tests."""
    return graph.hierarchical_communities(links(spark, sf_dir).withColumn("weight", F.lit(1.0)), most=4, levels=3)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = graph.member_hash(labels(spark, sf_dir))
    key = F.concat_ws("_", F.col("level").cast("string"), "community")
    text = F.when(F.col("size") % 5 != 0, F.concat(F.lit("Of "), F.col("size").cast("string"), F.lit(" parts")))
    return hashed.select(key.alias("key"), text.alias("text"), "level", F.col("community").alias("title"), "member_hash")


@query(f"WITH {LABELS} SELECT community AS title, count(*) AS size FROM labels WHERE level = 1 GROUP BY 1")
def level_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = labels(spark, sf_dir).groupBy("level", F.col("community").alias("title")).agg(F.count(F.lit(1)).alias("size"))
    return graph.reports_of_level(sizes, 1).select("title", "size")


@query(f"WITH {LABELS} SELECT community AS title, count(*) AS size FROM labels GROUP BY level, community")
def level_reports_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level without reports: all of them."""
    sizes = labels(spark, sf_dir).groupBy("level", F.col("community").alias("title")).agg(F.count(F.lit(1)).alias("size"))
    return graph.reports_of_level(sizes, 7).select("title", "size")


@query(
    f"""WITH {LABELS}, s AS (SELECT level, community, count(*) AS size FROM labels GROUP BY 1, 2)
SELECT concat('__community__', level, '_', community) AS id, concat('Of ', size, ' parts') AS text, level, community AS title FROM s
WHERE size % 5 <> 0 AND NOT (level = 0 AND community < 'Brand#3')"""
)
def index_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reports(spark, sf_dir)
    done = made.where("level = 0").select("key", F.when(F.col("title") < "Brand#3", F.col("member_hash")).otherwise("old").alias("indexed_hash"))
    return graph.reports_to_index(made, done)


@query("SELECT p_partkey AS id, ('0x' || substr(md5(concat('42#', p_partkey)), 1, 12))::BIGINT AS turn FROM part")
def shuffled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shuffled(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query(
    f"""WITH {ENTITIES}, {EDGES}, {LABELS} SELECT (SELECT count(DISTINCT lower(trim(name))) FROM mentions) AS entities, (SELECT count(*) FROM merged) AS relations,
  (SELECT count(DISTINCT community) FROM labels WHERE level = 0) AS communities, (SELECT count(DISTINCT (level, community)) FROM labels) AS community_summaries"""
)
def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = labels(spark, sf_dir).where("level = 0")
    merged = graph.merge_relations(relations(spark, sf_dir))
    return graph.graph_status(graph.merge_entities(mentions(spark, sf_dir)), merged, fine, reports(spark, sf_dir))


@query(
    """WITH n AS (SELECT concat('c', c_custkey) AS id, c_mktsegment AS type, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT id, type, degree FROM n WHERE type IN ('BUILDING', 'HOUSEHOLD') AND degree >= 3 ORDER BY degree DESC, id LIMIT 200"""
)
def graph_nodes_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("degree"))
    customer = table(spark, sf_dir, "customer").join(sizes, F.col("c_custkey") == F.col("o_custkey"), "left")
    nodes = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("type"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return graph.filter_nodes(nodes, ("BUILDING", "HOUSEHOLD"), 3, 200)


@query(
    f"""WITH {ENTITIES} SELECT DISTINCT lower(trim(name)) AS entity, chunk_id, source, substr(text, 1, 200) AS excerpt
FROM mentions JOIN documents ON doc_id = chunk_id WHERE doc_id % 3 <> 0"""
)
def node_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "source", "text")
    return graph.node_evidence(mentions(spark, sf_dir), known)


@query(f"WITH {EDGES} SELECT target, count(DISTINCT src) AS support FROM merged WHERE src IN ('c1', 'c2', 'c3', 'c4') GROUP BY 1")
def mutual_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.createDataFrame([(f"c{k}",) for k in (1, 2, 3, 4)], "entity string")
    return extraction.mutual_support(graph.merge_relations(relations(spark, sf_dir)), chosen)


@query(
    f"""WITH {EDGES}, o AS (SELECT src AS entity, *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, src, target, relation) AS rank, 'out' AS way FROM merged WHERE src IN ('c1', 'c2')),
i AS (SELECT target AS entity, *, row_number() OVER (PARTITION BY target ORDER BY weight DESC, src, target, relation) AS rank, 'in' AS way FROM merged WHERE target IN ('s3', 's4'))
SELECT entity, src, target, relation, CAST(rank AS INTEGER) AS rank, way FROM o WHERE rank <= 3 UNION ALL SELECT entity, src, target, relation, CAST(rank AS INTEGER), way FROM i WHERE rank <= 2"""
)
def top_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.createDataFrame([(k,) for k in ("c1", "c2", "s3", "s4")], "entity string")
    rows = extraction.top_relations(graph.merge_relations(relations(spark, sf_dir)), chosen)
    return rows.select("entity", "src", "target", "relation", "rank", "way")


# Names of parts that share a first letter are one alias group.
ALIASES = """g AS (SELECT DISTINCT p_name AS node, substr(p_name, 1, 1) AS component FROM part), f AS (SELECT p_name AS node, count(*) AS frequency FROM part GROUP BY 1),
names AS (SELECT node AS entity, first_value(node) OVER (PARTITION BY component ORDER BY frequency DESC, node) AS canonical FROM g JOIN f USING (node))"""


def alias_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    groups = part.select(F.col("p_name").alias("node"), F.substring("p_name", 1, 1).alias("component")).distinct()
    return extraction.canonical_names(groups, part.groupBy(F.col("p_name").alias("entity")).agg(F.count(F.lit(1)).alias("frequency")))


@query(f"WITH {ALIASES} SELECT * FROM names")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias_names(spark, sf_dir)


@query(
    f"""WITH {ALIASES}, r AS (SELECT p_partkey AS id, p_name AS src, lead(p_name) OVER (ORDER BY p_partkey) AS target FROM part)
SELECT id, coalesce(a.canonical, src) AS src, coalesce(b.canonical, target) AS target FROM r LEFT JOIN names a ON a.entity = src LEFT JOIN names b ON b.entity = target
WHERE coalesce(a.canonical, src) <> coalesce(b.canonical, target)"""
)
def aliased_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("target"))
    rows = part.join(after, "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("src"), "target")
    return extraction.apply_aliases(rows, alias_names(spark, sf_dir))


@query(
    """SELECT concat('n', p_partkey) AS id, p_brand AS label, 'a' AS backend FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT concat('n', p_partkey), p_type, 'b' FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 = 0"""
)
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id")
    part = table(spark, sf_dir, "part")
    nodes = {"a": part.where("p_partkey % 2 = 0").select(name, F.col("p_brand").alias("label")), "b": part.where("p_partkey % 3 = 0").select(name, F.col("p_type").alias("label"))}
    return extraction.merge_backends(nodes, nodes)[0].select("id", "label", "backend")


@query(f"WITH {FACTS} SELECT fact_id, CASE WHEN fact_id % 4 = 0 THEN 'superseded' ELSE status END AS status FROM facts")
def orphaned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact_plans.facts(spark, sf_dir)
    return fact_ops.orphans(rows, rows.where("fact_id % 4 <> 0").select("fact_id")).select("fact_id", "status")


PAYLOAD = f"""WITH {FACTS}, best AS (SELECT * FROM facts WHERE status = 'active' ORDER BY confidence DESC, fact_id LIMIT 500)"""


@query(
    PAYLOAD
    + """, ends AS (SELECT subject AS id FROM best UNION SELECT object FROM best),
e AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS type, concat('<', c_name, '> & "co"') AS description FROM customer)
SELECT id, substr(id, 1, 24) AS label, coalesce(type, 'UNKNOWN') AS type,
  concat('<b>', id, '</b><br/>', replace(replace(replace(replace(coalesce(description, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS tooltip
FROM ends LEFT JOIN e USING (id)"""
)
def fact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_payload(spark, sf_dir)[0]


@query(PAYLOAD + "SELECT subject AS source, object AS target, concat(lower(relation), ' (', CAST(CAST(valid_at AS DATE) AS VARCHAR), ')') AS label, relation, confidence AS value, 1 + confidence AS width FROM best")
def fact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_payload(spark, sf_dir)[1]


def fact_payload(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    said = F.concat(F.lit("<"), "c_name", F.lit('> & "co"'))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity"), F.col("c_mktsegment").alias("type"), said.alias("description"))
    return fact_ops.fact_payload(fact_plans.facts(spark, sf_dir), known)


@query(f"WITH {FACTS} SELECT fact_id, concat(subject, ' ', replace(lower(relation), '_', ' '), ' ', object) AS text FROM facts")
def fact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_ops.fact_texts(fact_plans.facts(spark, sf_dir))


@query(
    f"""WITH u AS (SELECT upper(event_type) AS relation, count(*) AS n FROM events GROUP BY 1), k AS (SELECT unnest({list(policies.RELATIONS) + ["CLICK"]!r}) AS relation)
SELECT relation, coalesce(n, 0) AS n, k.relation IS NOT NULL AS known FROM u FULL JOIN k USING (relation)"""
)
def relation_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.relation_types(table(spark, sf_dir, "events").select(F.col("event_type").alias("relation")), ("click",))


@query(f"WITH {FACTS} SELECT fact_id, subject, relation, object, scope_key FROM facts WHERE status = 'active'")
def facts_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported and read back by a reader of the shared graph."""
    at = folder(spark)
    stores.snapshot(graph.merge_entities(mentions(spark, sf_dir)), fact_plans.facts(spark, sf_dir), at)
    return stores.load(spark, at, "facts")["facts"].select("fact_id", "subject", "relation", "object", "scope_key")


@query(f"WITH {EDGES} SELECT src, target, relation, weight, ('0x' || substr(md5(src), 1, 8))::BIGINT % 16 AS shard FROM merged")
def relation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation graph saved by shard and loaded."""
    at = folder(spark)
    rows = graph.merge_relations(relations(spark, sf_dir)).select("src", "target", "relation", "weight")
    stores.save({"relations": rows.withColumn("shard", stores.shard_of("src", 16))}, at, {"relations": "shard"})
    found = stores.load(spark, at, "relations")["relations"]
    return found.select("src", "target", "relation", "weight", F.col("shard").cast("long").alias("shard"))


@query(
    f"""WITH {EDGES}, s AS (SELECT *, ('0x' || substr(md5(src), 1, 8))::BIGINT % 16 AS shard FROM merged)
SELECT src, target, relation, shard FROM s WHERE shard IN (SELECT shard FROM s WHERE src = 'c7')"""
)
def shards_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source's relations changed: its shard is written again, the others are not."""
    rows = graph.merge_relations(relations(spark, sf_dir)).select("src", "target", "relation")
    before = rows.where("src <> 'c7' OR relation <> 'A'")
    return stores.changed_shards(rows, before, 16).select("src", "target", "relation", "shard")


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS t FROM documents")
def text_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.text_payload(table(spark, sf_dir, "documents"), id_col="doc_id")["docs"]


@query("SELECT doc_id AS id, coalesce(text, '') AS text FROM documents")
def text_payload_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved with each text once, loaded whole."""
    at = folder(spark)
    stores.save(stores.text_payload(table(spark, sf_dir, "documents"), id_col="doc_id"), at)
    return stores.whole_docs(stores.load(spark, at, "texts", "docs"))


@query(f"WITH {INDEX} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 10")
def bm25_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in a lexical index that was saved and loaded."""
    at = folder(spark)
    stores.save({"bags": search.bags(table(spark, sf_dir, "documents"), id_col="doc_id")}, at)
    made = search.Bm25Index.of(stores.load(spark, at, "bags")["bags"])
    stores.save({"terms": made.terms, "stats": made.stats}, at)
    found = stores.load(spark, at, "bags", "terms", "stats")
    return search.Bm25Index.of(found["bags"], found["terms"], found["stats"]).search(asked(spark, sf_dir))


@query(
    """WITH s AS (SELECT doc_id AS chunk_id, string_split(text, '. ') AS l FROM documents)
SELECT chunk_id, CAST(unnest(range(len(l))) AS INTEGER) AS sentence_idx, unnest(l) AS sentence FROM s"""
)
def sentences_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    parts = F.posexplode(F.split("text", r"\. ")).alias("sentence_idx", "sentence")
    stores.save({"sentences": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), parts)}, at)
    return stores.load(spark, at, "sentences")["sentences"]


@query(f"WITH {INDEX} SELECT id, term, round(ln(1 + tf), 6) AS weight FROM postings")
def sparse_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    postings = search.Bm25Index.build(table(spark, sf_dir, "documents"), id_col="doc_id").postings
    stores.save({"weights": postings.select("id", "term", F.round(F.log1p("tf"), 6).alias("weight"))}, at)
    return stores.load(spark, at, "weights")["weights"]


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0")
def audit_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all even events, twice each, to a log that has every third event."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    even = events.where("event_id % 2 = 0")
    return stores.append_events(events.where("event_id % 3 = 0"), even.union(even))


# Readers, over files written from tables.
def written(frame: DataFrame, kind: str, **options: object) -> str:
    at = f"{folder(frame.sparkSession)}/rows.{kind}"
    frame.write.options(**options).format(kind).save(at)
    return at


ROWS = "'Context: {} | Columns: [c_custkey, c_name, c_mktsegment] | Data: c_custkey: ', c_custkey, ' | c_name: ', c_name, ' | c_mktsegment: ', c_mktsegment"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query(f"SELECT concat({ROWS.format('rows.csv')}) AS text FROM customer")
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.delimited(spark, written(customers(spark, sf_dir), "csv", header=True)).select("text")


@query(f"SELECT concat({ROWS.format('rows.csv')}) AS text FROM customer")
def read_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.delimited(spark, written(customers(spark, sf_dir), "csv", header=True, sep="\t"), sep="\t").select("text")


@query(f"SELECT concat({ROWS.format('rows.parquet')}) AS text FROM customer")
def read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parquet_rows(spark, written(customers(spark, sf_dir), "parquet")).select("text")


@query("SELECT text, CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE text IS NOT NULL")
def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    found = readers.json_documents(spark, written(rows, "json"), lines=True)
    return found.select("text", F.col("metadata")["doc_id"].alias("doc_id"))


@query("SELECT c_name AS text, CAST(c_custkey AS VARCHAR) AS k FROM customer")
def read_json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is one list of records."""
    record = F.to_json(F.struct(F.col("c_name").alias("content"), F.col("c_custkey").alias("k")))
    parts = customers(spark, sf_dir).groupBy((F.col("c_custkey") % 3).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    found = readers.json_documents(spark, written(parts.select("value").repartition(3), "text"), lines=True)
    return found.select("text", F.col("metadata")["k"].alias("k"))


@query("SELECT c_name AS text, concat('code_', CAST(c_custkey % 4 AS VARCHAR)) AS kind FROM customer WHERE c_custkey < 0 UNION ALL SELECT string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10), 'text' FROM customer")
def read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = written(customers(spark, sf_dir).orderBy("c_custkey").select("c_name").coalesce(1), "text")
    return readers.text_files(spark, at, "part-*").select("text", F.lit("text").alias("kind"))


@query("SELECT concat('INSERT ', c_custkey) AS text FROM customer UNION ALL SELECT concat('DELETE ', c_custkey) FROM customer")
def read_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    lines = F.concat(F.lit("INSERT "), key, F.lit(";\n-- note\n;\nDELETE "), key, F.lit(";"))
    return readers.sql_statements(spark, written(customers(spark, sf_dir).select(lines.alias("value")), "text")).select("text")


@query(r"SELECT item_id, concat('Title of ', item_id, ' See bold here.') AS text FROM benchmark")
def latex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id").cast("string")
    tex = F.concat(F.lit("\\documentclass{a}\n\\begin{document}\n\\section{Title of "), n, F.lit("}\n% gone\nSee \\textbf{bold} here\\cite{x}.\n\\begin{figure}no\\end{figure}\n\\end{document}"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.strip_latex(tex).alias("text"))


@query("SELECT item_id, concat('https://raw.githubusercontent.com/a/r', item_id, '/main/x.py') AS raw FROM benchmark")
def github_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://github.com/a/r"), F.col("item_id").cast("string"), F.lit("/blob/main/x.py"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.github_raw(url).alias("raw"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)(^|[^0-9A-Za-z])the([^0-9A-Za-z]|$)') AS has_the FROM documents")
def word_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_in(F.coalesce("text", F.lit("")), "the").alias("has_the"))


@query(
    """SELECT item_id, replace(replace(replace(replace(replace(concat(text, ' <b>&"''</b>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped,
  concat('works for ', item_id) AS words FROM benchmark"""
)
def escaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("text", F.lit(" <b>&\"'</b>"))
    words = T.relation_words(F.concat(F.lit("WORKS_FOR_"), F.col("item_id").cast("string")))
    return table(spark, sf_dir, "benchmark").select("item_id", T.html_escape(raw).alias("escaped"), words.alias("words"))


@query(
    """SELECT v.vec_id AS id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))
  * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings v JOIN embeddings q ON q.vec_id = v.vec_id - v.vec_id % 50"""
)
def cosine_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    other = rows.select(F.col("vec_id").alias("o"), F.col("embedding").alias("e"))
    return rows.join(other, F.col("o") == F.col("vec_id") - F.col("vec_id") % 50).select(F.col("vec_id").alias("id"), F.round(T.cosine(F.col("embedding"), F.col("e")), 6).alias("cosine"))
