"""Which rows take part, what a model is handed, and how sources are kept up: policies, contexts, ingestion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import context, fusion, graph, index, ingest, policies, rerank, search, windows
from skein.plans import ranking
from skein.plans.graphs import ENTITIES, mentions
from skein.plans.ranking import DENSE, LISTS, lexical
from skein.plans.registry import registry, table

QUERIES, query = registry()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of several kinds."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("id"),
        "source",
        "text",
        F.when(n % 4 == 0, "code").otherwise("prose").alias("source_class"),
        F.when(n % 5 == 1, "raptor").when(n % 5 == 2, "parent").alias("chunk_kind"),
        F.when(n % 7 == 0, 1).alias("raptor_level"),
        F.element_at(F.array(*map(F.lit, KINDS)), (n % len(KINDS) + 1).cast("int")).alias("kind"),
    )


KINDS = ("paper", "doc", "knowledge", "discussion", "codebase", "manifest", "reference", "other")
CHUNKS = f"""chunks AS (SELECT doc_id AS id, source, text, CASE WHEN doc_id % 4 = 0 THEN 'code' ELSE 'prose' END AS source_class,
  CASE doc_id % 5 WHEN 1 THEN 'raptor' WHEN 2 THEN 'parent' END AS chunk_kind, CASE WHEN doc_id % 7 = 0 THEN 1 END AS raptor_level,
  list_extract({list(KINDS)!r}, doc_id % 8 + 1) AS kind FROM documents)"""


@query(f"""WITH {CHUNKS} SELECT id FROM chunks WHERE source_class <> 'code' AND coalesce(chunk_kind, '') NOT IN ('raptor', 'parent') AND raptor_level IS NULL""")
def eligible_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(policies.eligible_sentences()).select("id")


@query(
    f"""WITH {CHUNKS} SELECT id, kind NOT IN ('knowledge', 'discussion', 'codebase', 'manifest', 'reference') AS summaries,
  kind NOT IN ('knowledge', 'codebase', 'manifest', 'reference') AS graph FROM chunks"""
)
def source_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    return chunks(spark, sf_dir).select(
        "id", policies.allowed(kind, "summaries").alias("summaries"), policies.allowed(kind, "graph").alias("graph")
    )


@query(
    f"""WITH {CHUNKS}, big AS (SELECT source FROM chunks GROUP BY 1 HAVING sum(len(text)) >= 0.02 * 1024 * 1024)
SELECT id, source FROM chunks JOIN big USING (source)"""
)
def large_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.large_sources(chunks(spark, sf_dir), 0.02).select("id", "source")


@query(
    f"""WITH {CHUNKS}, n AS (SELECT *, count(*) FILTER (WHERE raptor_level IS NULL) OVER (PARTITION BY source) AS leaves FROM chunks)
SELECT id, source FROM n WHERE raptor_level IS NOT NULL OR leaves < 40"""
)
def skip_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.skip_leaves(chunks(spark, sf_dir), 40).select("id", "source")


@query(f"WITH {ENTITIES}, {CHUNKS} SELECT id FROM chunks WHERE id NOT IN (SELECT chunk_id FROM mentions WHERE chunk_id % 2 = 0)")
def unextracted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even documents are extracted already."""
    done = mentions(spark, sf_dir).where("chunk_id % 2 = 0")
    return policies.unextracted(chunks(spark, sf_dir), done).select("id")


@query(
    f"""WITH {ENTITIES}, {CHUNKS}, c AS (SELECT chunk_id AS id, count(*) AS n FROM mentions GROUP BY 1 HAVING count(*) >= 2)
SELECT id, n AS n_entities FROM chunks JOIN c USING (id) ORDER BY n::DOUBLE / greatest(len(text), 1) DESC, id LIMIT 50"""
)
def relation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policies.relation_chunks(chunks(spark, sf_dir), mentions(spark, sf_dir), least=2, budget=50)
    return rows.select("id", "n_entities")


@query(
    """WITH e AS (SELECT p_name AS entity, count(*) AS frequency FROM part GROUP BY 1),
r AS (SELECT p_name AS src, p_brand AS target FROM part WHERE p_size = 1)
SELECT entity FROM e WHERE frequency >= 30 UNION SELECT src FROM r UNION SELECT target FROM r"""
)
def frequent_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    entities = part.groupBy(F.col("p_name").alias("entity")).agg(F.count(F.lit(1)).alias("frequency"))
    relations = part.where("p_size = 1").select(F.col("p_name").alias("src"), F.col("p_brand").alias("target"))
    return policies.frequent_entities(entities, relations, 30)


@query(
    """WITH d AS (SELECT p_brand AS entity, p_type AS description, p_partkey AS chunk_id FROM part WHERE p_size > 2),
f AS (SELECT entity, description, min(chunk_id) AS chunk_id, count(*) AS n FROM d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY chunk_id, description) AS k FROM f)
SELECT entity, string_agg(description, ';' ORDER BY k) FILTER (WHERE k <= 3) AS descriptions FROM r GROUP BY 1 HAVING count(*) > 1 AND sum(n) >= 3"""
)
def canonical_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_size > 2").select(
        F.col("p_brand").alias("entity"), F.col("p_type").alias("description"), F.col("p_partkey").alias("chunk_id")
    )
    found = policies.conflicting_descriptions(rows, least=3, most=3)
    return found.select("entity", F.array_join("descriptions", ";").alias("descriptions"))


@query(f"WITH {DENSE} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 15")
def over_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for five results of a hybrid search."""
    k = policies.over_fetch(5, rerank=False, hybrid=True)
    return search.dense_search(ranking.vectors(spark, sf_dir), ranking.vector_queries(spark, sf_dir), k)


@query(LISTS + "SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 30")
def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.rerank_pool(fusion.ranked(lexical(spark, sf_dir)), 10).select("query_id", "id", "rank")


@query(
    LISTS
    + """, s AS (SELECT b.query_id, b.id, CAST(-abs(len(i.text) - len(d.text)) AS DOUBLE) AS rerank_score
  FROM b JOIN documents d ON d.doc_id = b.id JOIN benchmark i ON i.item_id * 50 = b.query_id WHERE rank <= 20)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS INTEGER) AS rank FROM s"""
)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranking by an injected scorer of (query, text): here how near their lengths are."""

    def scorer(asked: pd.Series, text: pd.Series) -> pd.Series:
        return -(asked.str.len() - text.str.len()).abs().astype(float)

    return rerank.rerank(handed(spark, sf_dir, 20), scorer).select("query_id", "id", "rerank_score", "rank")


def handed(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best lexical results with their texts and their query's."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 50).alias("query_id"), F.col("text").alias("query_text"))
    hits = fusion.ranked(lexical(spark, sf_dir, k))
    return hits.join(texts, "id").join(asked, "query_id")


@query(
    """WITH c AS (SELECT item_id AS query_id, item_id % 10 / 10 AS confidence, item_id % 3 <> 0 AS has_local FROM benchmark)
SELECT query_id, has_local AND NOT confidence < 0.4 AS trust_local, NOT has_local OR confidence < 0.4 AS web_fallback FROM c"""
)
def correction_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id")
    told = rerank.correction(n % 10 / 10, n % 3 != 0, web=True)
    return table(spark, sf_dir, "benchmark").select(n.alias("query_id"), told.alias("t")).select("query_id", "t.trust_local", "t.web_fallback")


def first_part(asked: pd.Series, text: pd.Series) -> pd.Series:
    return text.str.slice(0, 100)


SHORT = """, h AS (SELECT b.query_id, b.id, b.rank, b.score, d.text, d.source, i.text AS query_text
  FROM b JOIN documents d ON d.doc_id = b.id JOIN benchmark i ON i.item_id * 50 = b.query_id WHERE rank <= 5)
"""


@query(LISTS + SHORT + "SELECT query_id, id, CASE WHEN len(text) > 100 AND trim(substr(text, 1, 100)) <> '' THEN substr(text, 1, 100) ELSE text END AS text FROM h")
def compressed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression by an injected model: here a text's first characters."""
    return context.compress(handed(spark, sf_dir, 5), first_part).select("query_id", "id", "text")


@query(
    LISTS
    + SHORT
    + """SELECT CAST(sum(len(text) // 4) AS BIGINT) AS before, CAST(sum(least(len(text), 100) // 4) AS BIGINT) AS after,
  round(sum(least(len(text), 100) // 4) / sum(len(text) // 4), 4) AS ratio FROM h"""
)
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = handed(spark, sf_dir, 5)
    return context.compression_ratio(rows, rows.withColumn("text", F.substring("text", 1, 100)))


@query(
    LISTS
    + SHORT
    + """SELECT query_id, string_agg(concat('[Document ', rank, ']', chr(10), text), concat(chr(10), chr(10)) ORDER BY rank) AS context FROM h GROUP BY 1"""
)
def built_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.build_context(handed(spark, sf_dir, 5))


@query(
    LISTS
    + SHORT
    + """SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score, CASE WHEN len(text) > 500 THEN concat(substr(text, 1, 500), '…') ELSE text END AS text FROM h"""
)
def slim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.slim_sources(handed(spark, sf_dir, 5))


@query(
    LISTS
    + """, a AS (SELECT item_id * 50 AS query_id, concat('See [', item_id % 9 + 1, '] and [Document ', item_id % 4 + 1, ', p. 3], [', item_id % 9 + 1, '] [99]') AS answer FROM benchmark),
n AS (SELECT query_id, CAST(unnest(regexp_extract_all(answer, '\\[(?:Document )?(\\d{1,6})[^\\]]*\\]', 1)) AS INTEGER) AS rank FROM a),
c AS (SELECT query_id, rank, count(*) AS n FROM n GROUP BY 1, 2)
SELECT query_id, c.rank AS rank, id, n FROM c JOIN b USING (query_id, rank)"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id")
    parts = ["See [", n % 9 + 1, "] and [Document ", n % 4 + 1, ", p. 3], [", n % 9 + 1, "] [99]"]
    answer = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    answers = table(spark, sf_dir, "benchmark").select((n * 50).alias("query_id"), answer.alias("answer"))
    return context.citations(answers, fusion.ranked(lexical(spark, sf_dir)))


@query(
    """WITH d AS (SELECT doc_id, text, unnest(range((len(text) + 999) // 1000)) AS part FROM documents WHERE len(text) > 0)
SELECT doc_id AS report_id, CAST(part AS INTEGER) AS part, substr(text, 1000 * part + 1, 1000) AS chunk FROM d"""
)
def report_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return context.report_chunks(reports, 1000)


@query(
    """WITH r AS (SELECT user_id AS query_id, event_id AS point, value AS score,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE value >= 20)
SELECT query_id, point, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50"""
)
def best_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("point"), F.col("value").alias("score")
    )
    return context.best_points(points)


@query(
    """WITH v AS (SELECT item_id AS query_id, [text, lower(text), substr(text, 1, 20)] AS l FROM benchmark),
f AS (SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM v)
SELECT query_id, CAST(unnest(range(len(l))) AS INTEGER) AS variant, unnest(l) AS text FROM f"""
)
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritings by an injected model: here in lower case, and cut."""

    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [t.lower(), t[:20]])

    return context.query_variants(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), rewrite)


WORDS = r"list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> ''))"


@query(
    f"""WITH w AS (SELECT doc_id AS id, unnest({WORDS}) AS w FROM documents), q AS (SELECT item_id AS query_id, {WORDS} AS ws FROM benchmark),
a AS (SELECT query_id, len(ws) AS n, unnest(ws) AS w FROM q),
s AS (SELECT query_id, id, round(count(*) / any_value(n), 6) AS score FROM a JOIN w USING (w) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def report_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return context.relevance(reports, table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"))


@query(
    LISTS
    + SHORT
    + """SELECT query_id, round(avg(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END), 6) AS fraction,
  round(avg(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END), 6) >= 0.3 AS boost FROM h GROUP BY 1"""
)
def code_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = handed(spark, sf_dir, 5).withColumn("source_class", F.when(F.col("id") % 3 == 0, "code"))
    return context.code_fraction(rows)


@query(
    LISTS
    + """, t AS (SELECT query_id, id FROM b WHERE rank IN (2, 5, 11)),
x AS (SELECT query_id, id, rank FROM b WHERE rank <= 10), g AS (SELECT query_id, count(*) AS given FROM x GROUP BY 1),
h AS (SELECT t.query_id, count(*) AS wanted, count(rank) AS hits, min(rank) AS first FROM t LEFT JOIN x USING (query_id, id) GROUP BY 1)
SELECT query_id, round(coalesce(hits / given, 0), 6) AS precision, round(hits / wanted, 6) AS recall, round(coalesce(1 / first, 0), 6) AS reciprocal_rank
FROM h LEFT JOIN g USING (query_id)"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fusion.ranked(lexical(spark, sf_dir))
    return context.retrieval_metrics(hits, hits.where("rank IN (2, 5, 11)").select("query_id", "id"), 10)


@query(
    LISTS
    + """, t AS (SELECT query_id, id FROM b WHERE rank IN (2, 5, 11)),
h AS (SELECT t.query_id, max(CASE WHEN b.rank <= 3 THEN 1 ELSE 0 END) AS hit FROM t JOIN b USING (query_id, id) GROUP BY 1)
SELECT round(avg(hit), 6) AS hit_rate_at_3 FROM h"""
)
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fusion.ranked(lexical(spark, sf_dir))
    return search.hit_rate(hits, hits.where("rank IN (2, 5, 11)").select("query_id", "id"), 3)


@query(
    LISTS
    + """, u AS (SELECT query_id, id, 'dense' AS kind, score * 0.5::DOUBLE AS score FROM v UNION ALL SELECT query_id, id, 'lexical', score * 2.0::DOUBLE FROM b)
SELECT query_id, u.id AS id, kind, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, u.id) AS INTEGER) AS rank, CAST(len(text) // 4 AS BIGINT) AS cost
FROM u JOIN documents ON doc_id = u.id"""
)
def local_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.extraction import local_context as merged

    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    parts = {"dense": ranking.dense(spark, sf_dir).join(texts, "id"), "lexical": lexical(spark, sf_dir).join(texts, "id")}
    return merged(parts, {"dense": 0.5, "lexical": 2.0}).select("query_id", "id", "kind", "score", "rank", "cost")


@query("SELECT doc_id, CASE WHEN starts_with(CAST(doc_id AS VARCHAR), '1_') THEN CAST(doc_id AS VARCHAR) ELSE concat('1_', doc_id) END AS id FROM documents")
def namespaced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ingest.namespaced(F.col("doc_id").cast("string"), "1").alias("id"))


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0 AND source IS NOT NULL) OR source IS NULL")
def purged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ingest.purge(docs, docs.where("doc_id % 97 = 0").select("source")).select("doc_id")


@query(
    """WITH k AS (SELECT o_custkey AS node, o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0)
SELECT node, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM k GROUP BY 1"""
)
def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    nodes = orders.groupBy(F.col("o_custkey").alias("node")).agg(F.collect_list("o_orderkey").alias("chunk_ids"))
    gone = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return ingest.prune_arrays(nodes, gone).select("node", F.array_join("chunk_ids", ",").alias("ids"))


@query(
    """WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 10 = 3 UNION SELECT source FROM documents WHERE doc_id = 5)
SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT id FROM ids) AND coalesce(source, '') NOT IN (SELECT id FROM ids)"""
)
def deleted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    gone = docs.where("CAST(id AS BIGINT) % 10 = 3").select("id").union(docs.where("id = '5'").select("source"))
    return ingest.delete_ids(docs, gone.distinct()).select("id")


@query("SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_sources, count(*) - count(DISTINCT doc_id % 900) AS id_collisions FROM documents")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ingest.ingest_stats(docs.select((F.col("doc_id") % 900).alias("id"), "source"))


@query(
    """WITH RECURSIVE p AS (SELECT DISTINCT c_custkey AS project, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0),
walk(project) AS (SELECT project FROM p WHERE parent = 2 UNION SELECT p.project FROM p JOIN walk ON p.parent = walk.project)
SELECT project FROM walk"""
)
def project_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_custkey > 0")
    return ingest.project_tree(rows.select(F.col("c_custkey").alias("project"), F.expr("c_custkey DIV 3").alias("parent")), 2)


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n_docs FROM documents WHERE doc_id % 3 < 2 GROUP BY 1")
def list_sources_of_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three stores, listed as one."""
    docs = table(spark, sf_dir, "documents")
    return ingest.list_sources(docs.where("doc_id % 3 = 0").unionByName(docs.where("doc_id % 3 = 1")))


@query("SELECT doc_id AS id, source, CAST(1 AS DOUBLE) AS score FROM documents WHERE doc_id % 50 = 0")
def fetched_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From two stores; an id that is in neither is ignored."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    ids = spark.range(0, 100_000_000, 50)
    stores = [search.get_by_ids(docs.where(F.col("id") % 2 == k), ids) for k in (0, 1)]
    return stores[0].unionByName(stores[1])


@query(
    """WITH s AS (SELECT doc_id AS chunk_id, doc_id % 4 AS hit, len(text) AS n, string_split(regexp_replace(text, '\\n', ' ', 'g'), '. ') AS l FROM documents),
r AS (SELECT chunk_id, CAST(unnest(range(len(l))) AS INTEGER) AS sentence_idx, unnest(l) AS sentence FROM s),
h AS (SELECT item_id AS query_id, chunk_id, sentence_idx, CAST(1000 - len(sentence) AS DOUBLE) AS score FROM r JOIN benchmark ON chunk_id % 40 = item_id % 40),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, sentence_idx) AS k FROM h)
SELECT query_id, chunk_id, b.sentence_idx AS sentence_idx, score, string_agg(r.sentence, ' ' ORDER BY r.sentence_idx) AS "window"
FROM b JOIN r USING (chunk_id) WHERE k = 1 AND r.sentence_idx BETWEEN b.sentence_idx - 2 AND b.sentence_idx + 2 GROUP BY 1, 2, 3, 4"""
)
def best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.posexplode(parts).alias("sentence_idx", "sentence"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("k"))
    score = (F.lit(1000) - F.length("sentence")).cast("double")
    hits = records.withColumn("k", F.col("chunk_id") % 40).join(items, "k").select("query_id", "chunk_id", "sentence_idx", score.alias("score"))
    return windows.best_windows(hits, records, 2)


@query(
    """WITH n AS (SELECT o_custkey AS parent, o_orderkey AS child, o_totalprice AS score FROM orders),
h AS (SELECT item_id AS query_id, item_id AS hit FROM benchmark UNION ALL SELECT item_id, item_id + 1 FROM benchmark),
r AS (SELECT query_id, hit, child AS id, score, row_number() OVER (PARTITION BY query_id, hit ORDER BY score DESC, child) AS k FROM h JOIN n ON parent = hit)
SELECT query_id, id, max(score) AS score FROM r WHERE k <= 3 GROUP BY 1, 2"""
)
def drilled_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as summaries over their orders."""
    orders = table(spark, sf_dir, "orders")
    nodes = orders.groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg(F.collect_list(F.concat(F.lit("o"), "o_orderkey")).alias("children_ids"))
    leaves = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    hits = items.union(items).withColumn("score", F.lit(1.0))
    hits = items.withColumn("n", F.col("query_id")).union(items.withColumn("n", F.col("query_id") + 1)).select("query_id", F.concat(F.lit("c"), "n").alias("id"))
    found = windows.drill_down(hits, nodes, leaves, 3)
    return found.select("query_id", F.substring("id", 2, 20).cast("long").alias("id"), "score")


@query(
    """WITH c AS (SELECT c_custkey, concat('n', c_nationkey) AS n FROM customer),
m AS (SELECT item_id AS query_id, item_id AS c FROM benchmark),
d AS (SELECT query_id, c AS node, 0.5 + 0.3 * 0.5 AS s FROM m UNION ALL
  SELECT query_id, o.c_custkey, 0.8 * 0.7 * 0.7 FROM m JOIN c ON c.c_custkey = m.c JOIN c o ON o.n = c.n AND o.c_custkey <> c.c_custkey),
s AS (SELECT query_id, o_orderkey AS id, round(max(s), 6) AS score FROM d JOIN orders ON o_custkey = node GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s ANTI JOIN
  (SELECT o_custkey AS query_id, o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0) USING (query_id, id))
SELECT query_id, id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def graph_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that the graph of customers and nations adds to a base of every fifth of one's own."""
    customer = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    edges = table(spark, sf_dir, "customer").select(customer.alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    orders = table(spark, sf_dir, "orders")
    told = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"), F.col("o_orderkey").alias("chunk_id"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    matches = items.select("query_id", F.concat(F.lit("c"), F.col("query_id").cast("string")).alias("entity"), F.lit(0.5).alias("score"))
    base = told.where("chunk_id % 5 = 0").join(matches, "entity").select("query_id", F.col("chunk_id").alias("id"))
    return graph.expand_results(base, matches, edges, told)


@query()
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted-file index; its recall is measured against the exact search in the tests."""
    made = index.VectorIndex.build(ranking.vectors(spark, sf_dir))
    return made.search(ranking.vector_queries(spark, sf_dir), probes=max(1, 3 * len(made.centroids) // 4))


def counted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(len(t)), float(t.count(" ")), float(t.count("."))])


@query(
    """SELECT doc_id, CAST(len(t) AS DOUBLE) AS e0, CAST(len(t) - len(replace(t, ' ', '')) AS DOUBLE) AS e1, CAST(len(t) - len(replace(t, '.', '')) AS DOUBLE) AS e2
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
)
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by an injected model: here of counted characters."""
    rows = index.embed(table(spark, sf_dir, "documents"), counted)
    return rows.select("doc_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(3)])


def weighed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: {"length": float(len(t)), "lines": float(t.count("\n")), "none": 0.0})


@query(
    """WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, 'length' AS term, CAST(len(t) AS DOUBLE) AS weight FROM t UNION ALL SELECT id, 'lines', CAST(len(t) - len(replace(t, chr(10), '')) AS DOUBLE) FROM t)
SELECT * FROM w WHERE weight > 0"""
)
def sparse_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by an injected encoder."""
    return index.encode_sparse(table(spark, sf_dir, "documents"), weighed, id_col="doc_id")


@query(
    """SELECT doc_id AS id, concat('Of ', coalesce(source, ''), chr(10), coalesce(text, '')) AS text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL
UNION ALL SELECT doc_id, text FROM documents WHERE source IS NULL AND text IS NOT NULL"""
)
def situated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contextual prefixes by an injected model: here the name of the source."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    parts = docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_id"))
    whole = docs.where("source IS NOT NULL").select(F.col("source").alias("source_id"), F.concat(F.lit("Of "), "source").alias("document")).distinct()
    return context.situate(parts, whole, lambda head, chunk: head).select("id", "text")
