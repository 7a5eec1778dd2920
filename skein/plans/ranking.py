"""Search, fusion and re-ranking over documents, embeddings and the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import jaccard, tokens
from skein.operators import fusion, rerank, search
from skein.plans.registry import registry, table
from skein.plans.retrieval import ROUTES, Config, search_routed
from skein.plans.routes import ROUTE_SQL

QUERIES, query = registry()

TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"
INDEX = f"""
words AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
lengths AS (SELECT id, len(w) AS dl FROM words),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
postings AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM words) GROUP BY 1, 2),
terms AS (
  SELECT term, count(*) AS df,
         ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf
  FROM postings, stats GROUP BY term
),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
scored AS (
  SELECT query_id, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (id), stats
  GROUP BY 1, 2
),
bm25 AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM scored WHERE score > 0
)"""
#: Every vector whose id is divisible by 50 asks against all.
DENSE = """
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, v.label,
         round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])
           / (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))
              * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0
),
dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs
)"""


def index(spark: SparkSession, sf_dir: str) -> search.Bm25Index:
    return search.Bm25Index.build(table(spark, sf_dir, "documents"), id_col="doc_id")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).where("id % 50 = 0")
    return rows.select(F.col("id").alias("query_id"), "embedding")


def lexical(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """BM25 hits of the documents that the vector queries stand for: ids are shared."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark")
    queries = items.select((F.col("item_id") * 50).alias("query_id"), "text")
    return search.bm25_search(docs, queries, k, id_col="doc_id").select("query_id", "id", "score")


LEXICAL = INDEX.replace("item_id AS query_id", "item_id * 50 AS query_id")
LISTS = f"""
WITH {LEXICAL}, {DENSE},
v AS (SELECT query_id, id, score, rank FROM dense WHERE rank <= 50),
b AS (SELECT query_id, id, score, rank FROM bm25 WHERE rank <= 50)
"""


def dense(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    hits = search.dense_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), k)
    return hits.select("query_id", "id", "score")


@query(f"WITH {INDEX} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 10")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_search(table(spark, sf_dir, "documents"), asked(spark, sf_dir), id_col="doc_id")


@query(f"WITH {INDEX} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 10")
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index's postings."""
    return index(spark, sf_dir).search(asked(spark, sf_dir))


@query(f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).terms.withColumn("idf", F.round("idf", 6))


@query(f"WITH {DENSE} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10")
def dense_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.dense_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir))
    return hits.select("query_id", "id", "score", "rank")


@query(
    f"""WITH {DENSE}, kept AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM pairs WHERE label = 3)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM kept WHERE rank <= 10"""
)
def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.dense_search(
        vectors(spark, sf_dir), vector_queries(spark, sf_dir), where=F.col("label") == 3
    )
    return hits.select("query_id", "id", "score", "rank")


@query(
    LISTS
    + """SELECT query_id, id,
  round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + b.rank), 0), 6) AS score,
  coalesce(v.score, 0) AS vector_score, v.rank IS NULL AS fused_only
FROM v FULL OUTER JOIN b USING (query_id, id)"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank(dense(spark, sf_dir), lexical(spark, sf_dir))


NORMED = """, lo AS (SELECT query_id, min(score) AS lv, max(score) AS hv FROM v GROUP BY 1),
lb AS (SELECT query_id, min(score) AS lb, max(score) AS hb FROM b GROUP BY 1),
nv AS (SELECT query_id, id, score, CASE WHEN hv > lv THEN (score - lv) / (hv - lv) WHEN hv > 0 THEN 1 ELSE 0 END AS nv FROM v JOIN lo USING (query_id)),
nb AS (SELECT query_id, id, CASE WHEN hb > lb THEN (score - lb) / (hb - lb) WHEN hb > 0 THEN 1 ELSE 0 END AS nb FROM b JOIN lb USING (query_id))
"""
WEIGHTED = """SELECT query_id, id, round(0.7 * coalesce(nv, 0) + (1 - 0.7) * coalesce(nb, 0), 6) AS score,
  coalesce(nv.score, 0) AS vector_score, nv IS NULL AS fused_only
FROM nv FULL OUTER JOIN nb USING (query_id, id)"""
WEIGHTED = WEIGHTED.replace("nv IS NULL", "nv.nv IS NULL").replace("coalesce(nv, 0)", "coalesce(nv.nv, 0)")


@query(LISTS + NORMED + WEIGHTED)
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted(dense(spark, sf_dir), lexical(spark, sf_dir))


@query(
    LISTS
    + """, sv AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM v),
sb AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM b)
SELECT query_id, id, round(CASE
    WHEN sb.score IS NULL THEN sv.score
    WHEN sv.score IS NULL THEN 0.3 * sb.score / sb.m
    ELSE 0.7 * sv.score / sv.m + 0.3 * sb.score / sb.m END, 6) AS score
FROM sv FULL OUTER JOIN sb USING (query_id, id)"""
)
def sparse_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.with_sparse(dense(spark, sf_dir), lexical(spark, sf_dir))


@query(
    LISTS
    + """, u AS (SELECT query_id, id, 0.6 / (60 + rank) AS s FROM v UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM b),
g AS (SELECT query_id, id, round(sum(s), 6) AS score FROM u GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM g"""
)
def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"dense": dense(spark, sf_dir), "lexical": lexical(spark, sf_dir)}
    return fusion.weighted_reciprocal_rank(lists, {"dense": 0.6})


@query(
    LISTS
    + """, f AS (SELECT query_id, id,
  round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + b.rank), 0), 6) AS score,
  coalesce(v.score, 0) AS vector_score, v.rank IS NULL AS fused_only
FROM v FULL OUTER JOIN b USING (query_id, id)) SELECT * FROM f WHERE fused_only OR vector_score >= 0.3"""
)
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.above_threshold(rrf_fusion(spark, sf_dir))


STORE = """SELECT query_id, id, score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r
  FROM pairs WHERE {where}) WHERE r <= 50"""


@query(
    f"""WITH {DENSE}, u AS ({STORE.format(where="label < 6")} UNION ALL {STORE.format(where="label > 3")})
SELECT query_id, id, max(score) AS score FROM u GROUP BY 1, 2"""
)
def multi_store_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked_for = vectors(spark, sf_dir), vector_queries(spark, sf_dir)
    stores = [
        search.dense_search(rows, asked_for, 50, where=where).select("query_id", "id", "score")
        for where in (F.col("label") < 6, F.col("label") > 3)
    ]
    return fusion.union_stores(*stores)


@query(
    f"""WITH {INDEX}, q AS (SELECT query_id, term, 1.0 AS q FROM asked),
w AS (SELECT id, term, ln(1 + tf) AS weight FROM postings),
s AS (SELECT query_id, id, round(sum(weight * q), 6) AS score FROM q JOIN w USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned-sparse search with log(1 + tf) in place of a model's weights."""
    weights = index(spark, sf_dir).postings.select("id", "term", F.log1p("tf").alias("weight"))
    q = asked(spark, sf_dir).select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return search.sparse_search(weights, q.withColumn("weight", F.lit(1.0)))


@query(
    LISTS
    + """, k AS (SELECT query_id, id, score, rank,
  CASE WHEN id % 5 = 0 THEN 'raptor' WHEN id % 7 = 0 THEN 'community' ELSE 'leaf' END AS kind FROM b),
s AS (SELECT query_id, id, score, kind, score * CASE kind WHEN 'leaf' THEN 1.5::DOUBLE WHEN 'raptor' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS ranking_score FROM k)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ranking_score DESC, id) AS INTEGER) AS rank FROM s"""
)
def artifact_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("id") % 5 == 0, "raptor").when(F.col("id") % 7 == 0, "community").otherwise("leaf")
    return rerank.artifact_ranking(lexical(spark, sf_dir).withColumn("kind", kind))


@query(
    LISTS
    + """, t AS (SELECT query_id, id, score, rank, false AS expanded FROM v WHERE rank <= 10),
x AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r
  FROM b ANTI JOIN t USING (query_id, id))
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank, expanded FROM t
UNION ALL SELECT query_id, id, score, CAST(r + 10 AS INTEGER), true FROM x WHERE r <= 3"""
)
def graph_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.graph_slots(dense(spark, sf_dir), lexical(spark, sf_dir))


@query(
    LISTS
    + """, r AS (SELECT b.*, source AS file, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS n
  FROM b JOIN documents ON doc_id = id)
SELECT query_id, id, score, file, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n > 2, score DESC, id) AS INTEGER) AS rank FROM r"""
)
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"))
    return rerank.file_cap(lexical(spark, sf_dir).join(files, "id"), 2).select(
        "query_id", "id", "score", "file", "rank"
    )


@query(
    LISTS
    + """, c AS (SELECT query_id, count(*) AS candidates FROM v GROUP BY 1),
k AS (SELECT query_id, id, score, source FROM v JOIN documents ON doc_id = id WHERE score >= 0.3),
a AS (SELECT c.query_id, any_value(candidates) AS candidates, count(id) AS n, coalesce(max(score), 0) AS top,
  CASE WHEN count(id) >= 2 THEN max(score) - min(score) ELSE 0 END AS spread,
  count(DISTINCT coalesce(source, CAST(id AS VARCHAR))) AS sources FROM c LEFT JOIN k USING (query_id) GROUP BY 1),
s AS (SELECT query_id, n, round(0.30 * round(least(1.0, n / 3.0), 4) + 0.30 * round(least(1.0, top / 0.6), 4)
  + 0.15 * round(least(1.0, spread / 0.25), 4) + 0.15 * round(least(1.0, sources / 2.0), 4)
  + 0.10 * round(least(1.0, n / candidates / 0.25), 4), 4) AS confidence FROM a)
SELECT *, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS verdict FROM s"""
)
def crag_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = dense(spark, sf_dir)
    totals = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return rerank.retrieval_confidence(hits.where("score >= 0.3").join(docs, "id"), totals)


@query()
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MMR of each query's 50 lexical candidates; held against a plain loop in the tests."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    own = F.max("score").over(Window.partitionBy("query_id"))
    hits = lexical(spark, sf_dir).withColumn("score", F.round(F.col("score") / own, 6))
    return rerank.mmr(hits.join(texts, "id"))


@query(
    LISTS
    + """, t AS (SELECT DISTINCT query_id, id, list_distinct(list_filter(string_split_regex(lower(d.text), '\\s+'), lambda x: x <> '')) AS w
  FROM b JOIN documents d ON d.doc_id = b.id WHERE b.rank <= 10),
q AS (SELECT item_id * 50 AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS qw FROM benchmark)
SELECT query_id, id, round(len(list_intersect(w, qw)) / len(list_distinct(list_concat(w, qw))), 6) AS jaccard FROM t JOIN q USING (query_id)"""
)
def query_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of each query's words and those of its ten best documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(tokens(F.col("text"))).alias("w"))
    items = table(spark, sf_dir, "benchmark")
    q = items.select((F.col("item_id") * 50).alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("qw"))
    hits = lexical(spark, sf_dir, 10).select("query_id", "id")
    return hits.join(docs, "id").join(q, "query_id").select(
        "query_id", "id", F.round(jaccard(F.col("w"), F.col("qw")), 6).alias("jaccard")
    )


#: Words that set the route of a question, by its number.
PHRASES = ("compare them all", "what is related to it", "the row of a table", "summarize it", "")
QUESTIONS = (
    "questions AS (SELECT item_id, concat(CASE item_id % 5 "
    + " ".join(f"WHEN {n} THEN '{phrase}'" for n, phrase in enumerate(PHRASES))
    + " END, ' ', CASE WHEN item_id % 5 = 4 THEN substr(text, 1, 60) ELSE text END) AS text FROM benchmark)"
)
ROUTED = f"""
WITH {QUESTIONS},
{LEXICAL.replace("FROM benchmark", "FROM questions")}, {DENSE},
routes(route, k, least, slots) AS (VALUES {", ".join(
    f"('{name}', {o.top_k}, {o.similarity_threshold}, {o.graph_budget})"
    for name, o in ((n, Config().with_overrides(**c)) for n, c in ROUTES.items())
)}),
routed AS (SELECT item_id * 50 AS query_id, {ROUTE_SQL} AS route FROM questions),
o AS (SELECT * FROM routed JOIN routes USING (route)),
v AS (SELECT query_id, id, score, rank FROM dense JOIN o USING (query_id) WHERE rank <= 3 * k),
b AS (SELECT query_id, id, score, rank FROM bm25 JOIN o USING (query_id) WHERE rank <= 3 * k AND query_id IN (SELECT query_id FROM v)),
f AS (SELECT query_id, id, round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + b.rank), 0), 6) AS score, v.score AS vector
  FROM v FULL OUTER JOIN b USING (query_id, id)),
r AS (SELECT f.*, route, k, row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, id) AS rank
  FROM f JOIN o USING (query_id) WHERE vector IS NULL OR vector >= least)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank, route FROM r WHERE rank <= k"""


@query(ROUTED)
def routed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with the options of each question's route."""
    n, text = F.col("item_id") % 5, F.col("text")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (n + 1).cast("int"))
    words = F.concat(phrase, F.lit(" "), F.when(n == 4, F.substring(text, 1, 60)).otherwise(text))
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 50).alias("query_id"), words.alias("text"))
    questions = items.join(vector_queries(spark, sf_dir), "query_id")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search_routed(questions, vectors(spark, sf_dir).select("id", "embedding"), documents)
