"""Code graphs and code search over the parts table, read as symbols of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import codegraph, rerank, routing, search
from skein.plans.registry import registry, table

QUERIES, query = registry()

#: A part is a symbol: its brand and type name the file, its name the symbol.
SYMBOLS = """
chunks AS (
  SELECT p_partkey AS id, concat('src/', replace(lower(p_brand), '#', ''), '/', replace(lower(p_type), ' ', '_'), '.py') AS file_path,
    CASE WHEN p_size % 3 = 0 THEN 'class' ELSE 'function' END AS symbol_type, CASE WHEN p_partkey % 11 <> 0 THEN replace(p_name, ' ', '_') END AS symbol_name,
    CASE WHEN p_size % 3 = 0 THEN concat('C', p_size, '.', replace(p_name, ' ', '_')) END AS qualified_name,
    concat('import src.brand', p_size % 7 + 1, '.', replace(lower(p_type), ' ', '_')) AS statement, p_size, p_retailprice
  FROM part
),
named AS (SELECT *, concat(file_path, '::', coalesce(qualified_name, symbol_name)) AS node_id FROM chunks WHERE coalesce(symbol_name, '') <> '')"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    kind = F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("src/"), brand, F.lit("/"), kind, F.lit(".py")).alias("file_path"),
        F.when(size % 3 == 0, "class").otherwise("function").alias("symbol_type"),
        F.when(F.col("p_partkey") % 11 != 0, name).alias("symbol_name"),
        F.when(size % 3 == 0, F.concat(F.lit("C"), size.cast("string"), F.lit("."), name)).alias("qualified_name"),
        F.array(F.concat(F.lit("import src.brand"), (size % 7 + 1).cast("string"), F.lit("."), kind)).alias("imports"),
        "p_size",
        "p_retailprice",
    )


@query(
    f"""WITH {SYMBOLS} SELECT file_path AS node_id, 'file' AS node_type, file_path AS name, file_path, count(*) AS n_chunks FROM chunks GROUP BY ALL
UNION ALL SELECT node_id, symbol_type, symbol_name, file_path, count(*) FROM named GROUP BY ALL"""
)
def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.code_nodes(chunks(spark, sf_dir))


CONTAINS = "contains AS (SELECT DISTINCT file_path AS source, node_id AS target, 'CONTAINS' AS edge_type FROM named)"


@query(f"WITH {SYMBOLS}, {CONTAINS} SELECT * FROM contains")
def code_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.contains_edges(chunks(spark, sf_dir))


@query(
    f"""WITH {SYMBOLS}, f AS (SELECT DISTINCT file_path, replace(file_path, '.py', '') AS bare FROM chunks),
i AS (SELECT DISTINCT file_path AS source, replace(replace(statement, 'import ', ''), '.', '/') AS module FROM chunks)
SELECT source, min(file_path) AS target, 'IMPORTS' AS edge_type FROM i JOIN f ON bare = module WHERE source <> file_path GROUP BY source, module"""
)
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.import_edges(chunks(spark, sf_dir))


@query(
    f"""WITH {SYMBOLS}, p AS (SELECT c_custkey AS id, concat('see ', replace(lower(c_mktsegment), ' ', '_'), ' ', (SELECT replace(min(p_name), ' ', '_') FROM part), '()') AS text FROM customer),
w AS (SELECT id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS name FROM p)
SELECT DISTINCT node_id AS source, w.id AS target, 'MENTIONED_IN' AS edge_type FROM w JOIN named ON symbol_name = name WHERE len(name) >= 4"""
)
def code_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = table(spark, sf_dir, "part").agg(F.replace(F.min("p_name"), F.lit(" "), F.lit("_"))).scalar()
    segment = F.replace(F.lower("c_mktsegment"), F.lit(" "), F.lit("_"))
    prose = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("see "), segment, F.lit(" "), least, F.lit("()")).alias("text"))
    return codegraph.mention_edges(code_nodes(spark, sf_dir), prose)


ASKED = """asked AS (SELECT item_id AS query_id, concat('where is ', replace(p_name, ' ', '_'), ' of src or ', substr(replace(p_name, ' ', '_'), 1, 5)) AS text
  FROM benchmark JOIN part ON p_partkey = item_id * 3),
tokens AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_.]{2,}\\b'))) AS token FROM asked)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    text = F.concat(F.lit("where is "), name, F.lit(" of src or "), F.substring(name, 1, 5))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 3).alias("p_partkey"))
    return items.join(table(spark, sf_dir, "part"), "p_partkey").select("query_id", text.alias("text"))


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"\b[A-Za-z_][A-Za-z0-9_.]{2,}\b"), F.lit(0))
    return asked(spark, sf_dir).select("query_id", F.explode(F.array_distinct(words)).alias("token"))


@query(
    f"""WITH {SYMBOLS}, {ASKED}, n AS (SELECT DISTINCT node_id, symbol_name AS name FROM named UNION SELECT DISTINCT file_path, file_path FROM chunks)
SELECT DISTINCT query_id, node_id FROM tokens JOIN n ON name = token OR (len(token) >= 4 AND contains(name, token))
UNION SELECT query_id, file_path FROM asked JOIN chunks ON id = query_id"""
)
def code_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    results = asked(spark, sf_dir).select("query_id").join(rows.select(F.col("id").alias("query_id"), "file_path"), "query_id")
    return codegraph.match_nodes(asked(spark, sf_dir), code_nodes(spark, sf_dir), results)


@query(
    """WITH t AS (SELECT item_id AS query_id, unnest(['CodeAwareSplitter', 'split_python_ast', 'skein.loaders', 'abc', concat('item', item_id)]) AS token FROM benchmark)
SELECT DISTINCT query_id, unnest(CASE token WHEN 'CodeAwareSplitter' THEN ['Code Aware Splitter', token] WHEN 'split_python_ast' THEN ['split python ast', token]
  WHEN 'skein.loaders' THEN ['skein loaders', 'loaders', token] WHEN 'abc' THEN [] ELSE [token] END) AS variant FROM t"""
)
def code_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("item"), F.col("item_id").cast("string"))
    words = F.array(*map(F.lit, ("CodeAwareSplitter", "split_python_ast", "skein.loaders", "abc")), own)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("token"))
    return codegraph.lexical_variants(rows)


@query(f"WITH {SYMBOLS}, {CONTAINS} SELECT * FROM contains EXCEPT SELECT file_path, node_id, 'CONTAINS' FROM named WHERE p_size % 2 = 0")
def code_new_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return codegraph.new_edges(codegraph.contains_edges(rows), codegraph.contains_edges(rows.where("p_size % 2 = 0")))


@query(
    f"""WITH {SYMBOLS}, {CONTAINS}, m AS (SELECT DISTINCT item_id AS query_id, node_id FROM benchmark JOIN named ON id = item_id * 3),
members AS (SELECT DISTINCT node_id, id FROM named UNION SELECT file_path, id FROM chunks),
near AS (SELECT query_id, node_id, 0 AS near FROM m UNION SELECT query_id, target, 1 FROM m JOIN contains ON source = node_id
  UNION SELECT query_id, source, 2 FROM m JOIN contains ON target = node_id),
c AS (SELECT query_id, near, id, row_number() OVER (PARTITION BY query_id, node_id, near ORDER BY id) AS n FROM near JOIN members USING (node_id)),
b AS (SELECT query_id, id, min(near) AS near FROM c WHERE near < 2 OR n <= 2 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near, id) AS rank FROM b)
SELECT query_id, id, near, CAST(rank AS INTEGER) AS rank, CAST(0.5 AS DOUBLE) AS score FROM r WHERE rank <= 10"""
)
def code_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    own = rows.where(F.coalesce("symbol_name", F.lit("")) != "")
    node = F.concat_ws("::", "file_path", F.coalesce("qualified_name", "symbol_name"))
    members = own.select(node.alias("node_id"), "id").union(rows.select("file_path", "id")).distinct()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 3).alias("id"))
    matched = own.join(items, "id").select("query_id", node.alias("node_id")).distinct()
    return codegraph.expand(matched, codegraph.contains_edges(rows), members, 5)


@query(
    f"""WITH {SYMBOLS}, {ASKED}, t AS (SELECT DISTINCT query_id, lower(token) AS token FROM tokens WHERE len(token) >= 3),
s AS (SELECT id, lower(symbol_name) AS s, lower(qualified_name) AS q FROM chunks),
exact AS (SELECT DISTINCT query_id, id FROM t JOIN s ON token = s OR token = q),
enough AS (SELECT query_id FROM exact GROUP BY 1 HAVING count(*) >= 10),
partial AS (SELECT DISTINCT query_id, id FROM t JOIN s ON contains(s, token) OR contains(q, token) WHERE query_id NOT IN (SELECT query_id FROM enough)),
a AS (SELECT query_id, id, CAST(1 AS DOUBLE) AS score FROM exact UNION ALL SELECT query_id, id, CAST(0.6 AS DOUBLE) FROM partial ANTI JOIN exact USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM a)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def symbol_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = chunks(spark, sf_dir).select("id", F.col("symbol_name").alias("symbol"), F.col("qualified_name").alias("qualified"))
    return search.symbol_search(symbols, query_tokens(spark, sf_dir), 10)


@query(
    f"""WITH {SYMBOLS}, {ASKED}, a AS (SELECT query_id, list(DISTINCT lower(token)) AS ts FROM tokens GROUP BY 1),
h AS (SELECT query_id, ts, id, 0.5 + id % 7 / 20 AS base, lower(symbol_name) AS s, lower(qualified_name) AS q, regexp_extract(file_path, '([^/]*)$', 1) AS f,
  concat('uses ', symbol_name, ' where it is') AS t, symbol_type, file_path AS file, p_size AS lines FROM a JOIN chunks ON id % 40 = query_id % 40 AND symbol_name IS NOT NULL),
b AS (SELECT *, (CASE WHEN list_contains(ts, s) THEN 1.0::DOUBLE WHEN len(list_filter(ts, lambda x: contains(s, x))) > 0 THEN 0.5 ELSE 0 END
  + CASE WHEN len(list_filter(ts, lambda x: contains(f, x))) > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN q IS NOT NULL AND list_contains(ts, q) THEN 1.0::DOUBLE ELSE 0 END
  + least(0.32::DOUBLE, 0.08::DOUBLE * len(list_filter(ts, lambda x: contains(lower(t), x))))) * CASE WHEN symbol_type = 'function' THEN 1.1::DOUBLE ELSE 1 END AS raw FROM h),
c AS (SELECT *, raw + CASE WHEN raw <= 0 THEN 0 WHEN lines <= 20 THEN 0.05::DOUBLE WHEN lines <= 50 THEN 0.02::DOUBLE ELSE 0 END AS boost FROM b),
m AS (SELECT *, max(boost) OVER (PARTITION BY query_id) AS most FROM c),
f AS (SELECT query_id, id, file, round(CASE WHEN most > 0 THEN 0.45 * base + 0.55 * boost / most ELSE base END, 6) AS score FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, id) > 3 AS over FROM f)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY over, score DESC, id) AS INTEGER) AS rank FROM o"""
)
def code_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).where("symbol_name IS NOT NULL").select(
        "id",
        (F.col("id") % 40).alias("k"),
        (F.lit(0.5) + F.col("id") % 7 / 20).alias("score"),
        F.concat(F.lit("uses "), "symbol_name", F.lit(" where it is")).alias("text"),
        F.col("symbol_name").alias("symbol"),
        F.col("qualified_name").alias("qualified"),
        F.col("file_path").alias("file"),
        "symbol_type",
        F.lit(1).alias("start_line"),
        F.col("p_size").alias("end_line"),
    )
    some = asked(spark, sf_dir).select("query_id", (F.col("query_id") % 40).alias("k"))
    return rerank.code_boost(rows.join(some, "k").drop("k"), query_tokens(spark, sf_dir)).select("query_id", "id", "score", "rank")


@query(
    """WITH q AS (SELECT item_id AS query_id, unnest([concat('splitters.py'), 'foo_bar.Baz', 'codeAware']) AS t FROM benchmark)
SELECT DISTINCT query_id, unnest(CASE t WHEN 'splitters.py' THEN ['splitters', 'py', 'splitters.py'] WHEN 'foo_bar.Baz' THEN ['foo_bar.baz', 'foo_bar', 'baz', 'foo', 'bar']
  ELSE ['codeaware', 'code', 'aware'] END) AS token FROM q"""
)
def code_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("splitters.py foo_bar.Baz codeAware")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(routing.code_tokens(text)).alias("token"))
    return rows.distinct()


@query(
    """WITH f AS (SELECT concat('m', item_id, '.py') AS source, concat('C', item_id) AS c, item_id FROM benchmark)
SELECT source, source AS subject, 'CONTAINS' AS relation, c AS object FROM f UNION ALL SELECT source, c, 'INHERITS', 'Base' FROM f
UNION ALL SELECT source, source, 'IMPORTS', 'os' FROM f UNION ALL SELECT source, source, 'CONTAINS', concat('f', item_id) FROM f WHERE item_id % 2 = 0"""
)
def python_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id").cast("string")
    odd = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("def f"), n, F.lit("(): pass\n"))).otherwise("")
    text = F.concat(F.lit("import os\nclass C"), n, F.lit("(Base):\n    def inner(self): pass\n"), odd)
    files = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("m"), n, F.lit(".py")).alias("source"), text.alias("text"))
    return codegraph.python_facts(files.union(files.select(F.lit("broken.py"), F.lit("def (:"))))


@query(
    f"""WITH {SYMBOLS}, w AS (SELECT item_id AS query_id, symbol_name AS want, file_path AS want_file FROM benchmark JOIN chunks ON id = item_id * 3),
r AS (SELECT query_id, want, want_file, symbol_name, file_path, p_size * 5 > 100 AS broad, id % 2 = 0 AS fb FROM w LEFT JOIN chunks ON id % 60 = query_id % 60),
g AS (SELECT query_id, coalesce(bool_or(lower(symbol_name) = lower(want)), false) AS hit, coalesce(bool_or(file_path = want_file), false) AS file_hit,
  coalesce(avg(CASE WHEN broad THEN 1 WHEN NOT broad THEN 0 END), 0) AS broad, coalesce(bool_or(fb), false) AS fb FROM r GROUP BY 1)
SELECT query_id, NOT hit AS exact_symbol_missed, NOT hit AND file_hit AS right_file_wrong_block, broad > 0.5 AS too_many_broad_chunks, fb AS fallback_chunk_involved FROM g"""
)
def retrieval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    want = items.withColumn("id", F.col("query_id") * 3).join(rows, "id").select("query_id", F.col("symbol_name").alias("symbol"), F.col("file_path").alias("file"))
    found = items.withColumn("k", F.col("query_id") % 60).join(rows.withColumn("k", F.col("id") % 60), "k").select(
        "query_id", "id", F.col("symbol_name").alias("symbol"), F.col("file_path").alias("file"),
        F.lit(0).alias("start_line"), (F.col("p_size") * 5).alias("end_line"), (F.col("id") % 2 == 0).alias("is_fallback"),
    )
    return codegraph.retrieval_failures(found, want)
