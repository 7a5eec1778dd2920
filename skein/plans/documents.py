"""Documents and pages: scalars, chunks, windows, ingestion and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import chunking, ingest, routing, windows
from skein.plans.registry import registry, table
from skein.plans.routes import ROUTE_SQL

QUERIES, query = registry()

SENTENCES = """
pieces AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1␞', 'g'), '␞'), lambda x: trim(x)), lambda x: x <> '') AS p
  FROM documents
),
parts AS (
  SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, b:
    CASE WHEN len(b[1]) < 10 THEN list_concat(a[1:-2], [concat(a[-1], ' ', b[1])]) ELSE list_concat(a, b) END) AS s
  FROM pieces WHERE len(p) > 0
),
records AS (
  SELECT doc_id AS chunk_id, len(s) AS total_sentences, unnest(range(len(s))) AS sentence_idx, unnest(s) AS sentence FROM parts
)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normalized, md5(text) AS hash,
  sha256(trim(text)) AS trimmed_hash, CAST(floor(len(text) / 4) AS BIGINT) AS tokens,
  CAST(len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents"""
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id",
        T.normalize_space(text).alias("normalized"),
        T.doc_hash(text).alias("hash"),
        T.trimmed_sha256(text).alias("trimmed_hash"),
        T.token_estimate(text).alias("tokens"),
        F.size(T.tokens(text)).cast("long").alias("words"),
    )


@query(
    """WITH seen AS (SELECT DISTINCT md5(text) AS hash FROM documents WHERE source = 'src0')
SELECT doc_id, md5(text) AS hash FROM documents WHERE source <> 'src0' AND md5(text) NOT IN (SELECT hash FROM seen)"""
)
def dedup_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the other sources is new after the first one was ingested."""
    rows = docs(spark, sf_dir)
    seen = rows.where("source = 'src0'").select(F.md5("text").alias("hash")).distinct()
    return ingest.unseen(rows.where("source <> 'src0'"), seen).select("doc_id", "hash")


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n_docs FROM documents GROUP BY 1")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.list_sources(docs(spark, sf_dir))


LANES = ", ".join(
    f"CAST(sum(CAST(concat('0x', substr(h, {1 + 8 * k}, 8)) AS BIGINT)) AS VARCHAR)" for k in range(4)
)


@query(
    f"""WITH c AS (SELECT source, md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)) AS h FROM documents)
SELECT source, md5(concat_ws('-', {LANES})) AS content_hash, count(*) AS chunk_count FROM c GROUP BY source"""
)
def source_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.source_versions(docs(spark, sf_dir), "doc_id")


@query(
    """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
WHERE n <= 20"""
)
def chunk_cap_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.cap_per_source(docs(spark, sf_dir), 20, "doc_id").select("doc_id", "source")


@query(
    """WITH s AS (SELECT user_id AS source, max(ts) AS ingested_at FROM events GROUP BY 1),
n AS (SELECT max(ts) AS now FROM events)
SELECT source, ingested_at, round((epoch_us(now) - epoch_us(ingested_at)) / 86400000000, 1) AS age_days
FROM s, n WHERE (epoch_us(now) - epoch_us(ingested_at)) / 86400000000 > 0.25"""
)
def stale_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar()
    sources = events.groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("ingested_at"))
    return ingest.stale(sources, now, 0.25)


@query(
    """SELECT c_custkey, concat('Context: customer | Columns: [c_name, c_mktsegment, c_nationkey] | Data: ',
  concat_ws(' | ', 'c_name: ' || c_name, 'c_mktsegment: ' || c_mktsegment, 'c_nationkey: ' || c_nationkey)) AS text FROM customer"""
)
def table_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ingest.table_row_text(["c_name", "c_mktsegment", "c_nationkey"], "customer")
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


@query(
    """WITH w AS (SELECT doc_id AS source_id, text, unnest(range(0, len(text), 800)) AS s,
  len(range(0, len(text), 800)) AS total_chunks FROM documents WHERE len(text) > 0)
SELECT source_id, CAST(s // 800 AS INTEGER) AS chunk_index, concat(source_id, '_chunk_', s // 800) AS id,
  substring(text, s + 1, 1000) AS chunk, CAST(total_chunks AS INTEGER) AS total_chunks FROM w"""
)
def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_windows(docs(spark, sf_dir), id_col="doc_id")


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(docs(spark, sf_dir), "semantic", id_col="doc_id", size=100, overlap=20)


#: Where a window that starts at ``s`` ends: after its last paragraph, line or word end, else in full.
CUT = """CASE WHEN n - s <= 300 THEN n ELSE s + list_reduce([
    CASE WHEN contains(w, e'\\n\\n') THEN 301 - instr(reverse(w), e'\\n\\n') WHEN contains(w, e'\\n') THEN 301 - instr(reverse(w), e'\\n')
      WHEN contains(w, ' ') THEN 301 - instr(reverse(w), ' ') ELSE 0 END, 300], lambda a, b: CASE WHEN a > 30 THEN a ELSE b END) END"""


@query(
    rf"""WITH RECURSIVE d AS (SELECT doc_id, text, len(text) AS n, 0 AS s FROM documents WHERE text <> ''),
walk(doc_id, text, n, s, stop) AS (
  SELECT doc_id, text, n, s, {CUT} FROM (SELECT *, substr(text, s + 1, 300) AS w FROM d)
  UNION ALL
  SELECT doc_id, text, n, s, {CUT} FROM (SELECT doc_id, text, n, stop - 30 AS s, substr(text, stop - 29, 300) AS w FROM walk WHERE stop < n)
),
c AS (SELECT doc_id, s, regexp_replace(substr(text, s + 1, stop - s), '^\s+|\s+$', '', 'g') AS chunk FROM walk),
k AS (SELECT doc_id AS source_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS total FROM c WHERE chunk <> '')
SELECT source_id, CAST(i AS INTEGER) AS chunk_index, concat(source_id, '_chunk_', i) AS id, chunk, CAST(total AS INTEGER) AS total_chunks FROM k"""
)
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(docs(spark, sf_dir), "recursive", id_col="doc_id", size=300, overlap=30)


@query(
    f"""WITH {SENTENCES} SELECT chunk_id, CAST(total_sentences AS INTEGER) AS total_sentences,
CAST(sentence_idx AS INTEGER) AS sentence_idx, sentence FROM records"""
)
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sentence_records(docs(spark, sf_dir), id_col="doc_id")


@query(
    f"""WITH {SENTENCES} SELECT chunk_id, CAST(sentence_idx AS INTEGER) AS sentence_idx,
string_agg(sentence, ' ' ORDER BY sentence_idx) OVER (PARTITION BY chunk_id ORDER BY sentence_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS "window"
FROM records""".replace(" ORDER BY sentence_idx) OVER", ") OVER")
)
def sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = windows.sentence_records(docs(spark, sf_dir), id_col="doc_id")
    return windows.sentence_windows(records).select("chunk_id", "sentence_idx", "window")


HEADED = """h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, doc_id % 7 = 0 AS is_heading, text FROM documents),
s AS (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY source ORDER BY i) AS section FROM h),
b AS (SELECT *, (row_number() OVER (PARTITION BY source, section ORDER BY i) - 1) // 5 AS block FROM s)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("is_heading", F.col("doc_id") % 7 == 0)
    return windows.structure_blocks(rows.withColumn("id", F.col("doc_id")), 5, "doc_id")


@query(f"WITH {HEADED} SELECT doc_id, source, CAST(section AS BIGINT) AS section, CAST(block AS BIGINT) AS block FROM b")
def raptor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "source", "section", F.col("block").cast("long").alias("block"))


@query(
    f"""WITH {HEADED} SELECT source, CAST(section AS BIGINT) AS section, CAST(block AS BIGINT) AS block,
array_to_string(list(doc_id ORDER BY doc_id), ',') AS children, md5(substring(string_agg(text, ' ' ORDER BY doc_id), 1, 4000)) AS text_hash
FROM b GROUP BY 1, 2, 3"""
)
def raptor_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = windows.summarise_blocks(blocks(spark, sf_dir), order_col="doc_id")
    return nodes.select(
        "source",
        "section",
        F.col("block").cast("long").alias("block"),
        F.array_join(F.col("children_ids").cast("array<string>"), ",").alias("children"),
        F.md5("text").alias("text_hash"),
    )


@query(
    f"""SELECT conv_id, turn, {ROUTE_SQL} AS route,
  regexp_matches(lower(text), '{"|".join(routing.HOLISTIC)}') OR len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 20 AS graph
FROM conversations"""
)
def query_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", routing.query_route(text).alias("route"), routing.needs_graph(text).alias("graph")
    )


@query(
    """WITH l AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: trim(x) <> '') AS ls FROM documents),
n AS (SELECT doc_id, text, len(ls) AS n, len(list_filter(ls, lambda x: regexp_matches(ltrim(x), 'CODE'))) AS code,
  len(text) - len(replace(text, ',', '')) AS commas, len(text) - len(replace(text, chr(9), '')) AS tabs,
  len(regexp_extract_all(substring(text, 1, 2000), 'PAPER')) AS papers FROM l)
SELECT doc_id, CASE WHEN n = 0 THEN 'doc' WHEN commas / n > 2 OR tabs / n > 1.5 THEN 'knowledge'
  WHEN code / n > 0.15 AND code / n < 0.5 THEN 'doc' WHEN code / n >= 0.5 THEN 'codebase'
  WHEN papers >= 2 THEN 'paper' ELSE 'doc' END AS type FROM n""".replace("CODE", routing.CODE_LINE).replace("PAPER", routing.PAPER)
)
def dataset_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = routing.dataset_type(F.col("text"), F.col("source"))
    return docs(spark, sf_dir).select("doc_id", kind["type"].alias("type"))


@query(
    r"""SELECT conv_id, turn, regexp_matches(text, '[a-z][A-Z]') OR regexp_matches(text, '[a-z]_[a-z]')
  OR regexp_matches(text, '\.(EXT)') OR regexp_matches(text, '(?i)(^|\s)(SYM)(\s|$)') AS code FROM conversations""".replace(
        "EXT", "py|go|rs|ts|js|sh|rb|jl|cpp|c|java|kt"
    ).replace("SYM", "|".join(routing.SYMBOL_WORDS))
)
def code_query_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.looks_like_code(F.col("text")).alias("code"))


@query(
    """SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS stripped FROM pages""".replace(
        "SELECT page_id, ", "SELECT page_id, trim(regexp_replace("
    ).replace(" AS stripped", ", '\\s+', ' ', 'g')) AS stripped")
)
def tag_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("stripped"))


@query(
    """WITH v AS (SELECT source, string_agg(md5(text), '' ORDER BY doc_id) AS now,
  string_agg(md5(text), '' ORDER BY doc_id) FILTER (WHERE doc_id % 100 <> 0) AS old FROM documents GROUP BY 1)
SELECT source FROM v WHERE old IS NULL OR old <> now"""
)
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    now = ingest.source_versions(rows, "doc_id")
    stored = ingest.source_versions(rows.where("doc_id % 100 <> 0"), "doc_id")
    return ingest.changed_sources(now, stored).select("source")
