"""Code graphs: files, symbols and imports as nodes and edges; expansion and bridges to prose."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.components import hot_keys, lookup
from skein.session import cut_lineage


def code_nodes(chunks: DataFrame) -> DataFrame:
    """(node_id, node_type, name, file_path, n_chunks) of files and symbols.

    ``chunks`` has (id, file_path, symbol_type, symbol_name, qualified_name, imports).
    """
    files = chunks.select(
        F.col("file_path").alias("node_id"), F.lit("file").alias("node_type"), F.col("file_path").alias("name"), "file_path", "id"
    )
    symbols = chunks.where(F.coalesce("symbol_name", F.lit("")) != "").select(
        F.concat_ws("::", "file_path", F.coalesce("qualified_name", "symbol_name")).alias("node_id"),
        F.col("symbol_type").alias("node_type"),
        F.col("symbol_name").alias("name"),
        "file_path",
        "id",
    )
    return (
        files.unionByName(symbols)
        .groupBy("node_id", "node_type", "name", "file_path")
        .agg(F.count_distinct("id").alias("n_chunks"))
    )


def contains_edges(chunks: DataFrame) -> DataFrame:
    named = chunks.where(F.coalesce("symbol_name", F.lit("")) != "")
    target = F.concat_ws("::", "file_path", F.coalesce("qualified_name", "symbol_name"))
    return named.select(
        F.col("file_path").alias("source"), target.alias("target"), F.lit("CONTAINS").alias("edge_type")
    ).distinct()


def import_edges(chunks: DataFrame) -> DataFrame:
    """Files to the file that an imported module names: the least path that ends in it.

    Every suffix of every path is a join key, so this is an equi-join, not a comparison of all.
    """
    files = chunks.select("file_path").distinct()
    bare = F.regexp_replace(F.regexp_replace("file_path", r"\.[^./]+$", ""), r"/__init__$", "")
    parts = F.split(bare, "/")
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "/")
    )
    keyed = files.select(F.col("file_path").alias("target"), F.explode(suffixes).alias("module"))
    first = keyed.groupBy("module").agg(F.min("target").alias("target"))
    statement = F.regexp_extract(F.trim("statement"), r"^(?:from\s+|import\s+)?([A-Za-z_][\w./]*)", 1)
    wanted = (
        chunks.select(F.col("file_path").alias("source"), F.explode("imports").alias("statement"))
        .select("source", F.replace(statement, F.lit("."), F.lit("/")).alias("module"))
        .where("module <> ''")
        .distinct()
    )
    return (
        wanted.join(first, "module")
        .where("source <> target")
        .select("source", "target", F.lit("IMPORTS").alias("edge_type"))
        .distinct()
    )


def mention_edges(nodes: DataFrame, prose: DataFrame) -> DataFrame:
    """Symbols of four or more characters to the prose chunks (id, text) that name them as a word. Prose
    that says a frequent word stays where it is: the symbols of that name are broadcast."""
    symbols = nodes.where((F.col("node_type") != "file") & (F.length("name") >= 4)).select("node_id", "name").distinct()
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))
    spoken = prose.select("id", F.explode(words).alias("name")).where(F.length("name") >= 4)
    spoken = cut_lineage(spoken.distinct())
    hot = hot_keys(spoken, "name")
    # a node of one name meets a chunk once; only others can repeat an edge
    span = symbols.groupBy("node_id").agg(F.min("name").alias("name"), F.max("name").alias("last"))
    several = symbols.join(span.where("name <> last"), "node_id", "left_semi")

    def edges(named: DataFrame) -> DataFrame:
        found = lookup(spoken, named.select("node_id", "name"), "name", hot)
        return found.select(F.col("node_id").alias("source"), F.col("id").alias("target"), F.lit("MENTIONED_IN").alias("edge_type"))

    return edges(span.where("name = last")).unionByName(edges(several).distinct())


def expand(matched: DataFrame, edges: DataFrame, members: DataFrame, k: int, score: float = 0.5) -> DataFrame:
    """Chunks around matched nodes (query_id, node_id): their own, those of the nodes they point
    at, the first two of the nodes that contain them; at most 2 * k a query.

    ``members`` has (node_id, id).
    """
    own = matched.select("query_id", "node_id", F.lit(0).alias("near"))
    out = matched.join(edges.withColumnRenamed("source", "node_id"), "node_id").select(
        "query_id", F.col("target").alias("node_id"), F.lit(1).alias("near")
    )
    inward = (
        matched.join(edges.where("edge_type = 'CONTAINS'").withColumnRenamed("target", "node_id"), "node_id")
        .select("query_id", F.col("source").alias("node_id"), F.lit(2).alias("near"))
    )
    by_node = Window.partitionBy("query_id", "node_id", "near").orderBy("id")
    chunks = (
        own.union(out).union(inward).distinct().join(members, "node_id").withColumn("_n", F.row_number().over(by_node))
    )
    few = chunks.where((F.col("near") < 2) | (F.col("_n") <= 2))
    order = Window.partitionBy("query_id").orderBy("near", "id")
    best = few.groupBy("query_id", "id").agg(F.min("near").alias("near"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * k).withColumn(
        "score", F.lit(score)
    )


def python_facts(files: DataFrame) -> DataFrame:
    """(source, subject, relation, object) of Python files (source, text): classes and what they
    inherit from, top-level functions, imports. A file that does not parse has none."""

    def facts(source: str, text: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            return
        for node in tree.body:
            if isinstance(node, ast.ClassDef):
                yield source, source, "CONTAINS", node.name
                for base in node.bases:
                    yield source, node.name, "INHERITS", ast.unparse(base)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                yield source, source, "CONTAINS", node.name
            elif isinstance(node, ast.Import):
                for name in node.names:
                    yield source, source, "IMPORTS", name.name
            elif isinstance(node, ast.ImportFrom) and node.module:
                yield source, source, "IMPORTS", node.module

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [f for s, t in zip(batch["source"], batch["text"], strict=True) for f in facts(s, t)]
            yield pd.DataFrame(rows, columns=["source", "subject", "relation", "object"])

    schema = "source string, subject string, relation string, object string"
    return files.select("source", "text").mapInPandas(run, schema)


def retrieval_failures(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Labels of each query's results (query_id, id, symbol, file, start_line, end_line, is_fallback)
    against ``expected`` (query_id, symbol, file)."""
    want = expected.select("query_id", F.col("symbol").alias("want"), F.col("file").alias("want_file"))
    joined = want.join(results, "query_id", "left").groupBy("query_id").agg(
        F.coalesce(F.bool_or(F.lower("symbol") == F.lower("want")), F.lit(False)).alias("hit"),
        F.coalesce(F.bool_or(F.col("file") == F.col("want_file")), F.lit(False)).alias("file_hit"),
        F.coalesce(F.avg((F.col("end_line") - F.col("start_line") > 100).cast("int")), F.lit(0.0)).alias("broad"),
        F.coalesce(F.bool_or("is_fallback"), F.lit(False)).alias("fallback"),
    )
    return joined.select(
        "query_id",
        (~F.col("hit")).alias("exact_symbol_missed"),
        (~F.col("hit") & F.col("file_hit")).alias("right_file_wrong_block"),
        (F.col("broad") > 0.5).alias("too_many_broad_chunks"),
        F.col("fallback").alias("fallback_chunk_involved"),
    )


def match_nodes(queries: DataFrame, nodes: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id): nodes whose name is an identifier of the query (three or more
    characters) or contains one of four or more, and the files of results (query_id, file_path).

    Containment is an equi-join: names are cut into their runs of the lengths asked for.
    """
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z_][A-Za-z0-9_.]{2,}\b"), F.lit(0)))
    asked = queries.select("query_id", F.explode(words).alias("token"))
    names = nodes.select("name").distinct()
    sizes = F.broadcast(asked.where(F.length("token") >= 4).select(F.length("token").alias("n")).distinct())
    starts = F.sequence(F.lit(1), F.length("name") - F.col("n") + 1)
    runs = names.join(sizes, F.length("name") >= F.col("n")).select(
        "name", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("name", i, F.col("n"))))).alias("token")
    )
    whole = names.select("name", F.col("name").alias("token"))
    found = runs.union(whole).join(asked, "token").select("query_id", "name").join(nodes.select("name", "node_id"), "name")
    matched = found.select("query_id", "node_id")
    if results is not None:
        files = results.select("query_id", F.col("file_path").alias("node_id")).join(nodes.select("node_id"), "node_id", "left_semi")
        matched = matched.unionByName(files.select("query_id", "node_id"))
    return matched.distinct()


def lexical_variants(query_tokens: DataFrame) -> DataFrame:
    """(query_id, variant) of code identifiers (query_id, token) for the lexical channel alone: the
    words of camel and snake case, the last part of a dotted path, and the token itself; tokens of
    under four characters make none."""
    token = F.col("token")
    camel = F.filter(F.regexp_extract_all(token, F.lit(r"([A-Z][a-z0-9]*|[a-z][a-z0-9]*)"), F.lit(1)), lambda p: F.length(p) >= 2)
    pieces = F.size(F.regexp_extract_all(token, F.lit(r"([A-Z][a-z0-9]*|[a-z][a-z0-9]*)"), F.lit(1)))
    snake = F.filter(F.split(token, "_"), lambda p: F.length(p) >= 2)
    base = F.regexp_extract(token, r"([^.]*)$", 1)
    forms = F.array(
        F.when(pieces > 1, F.array_join(camel, " ")),
        F.when(F.contains(token, F.lit("_")) & (F.size(snake) > 1), F.array_join(snake, " ")),
        F.when(F.contains(token, F.lit(".")) & (F.length(base) >= 4), base),
        token,
    )
    rows = query_tokens.where(F.length("token") >= 4).select("query_id", F.explode(F.array_compact(forms)).alias("variant"))
    return rows.where("variant <> ''").distinct()


def new_edges(made: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges (source, target, edge_type) of a new build that are not stored yet, each once."""
    key = ["source", "target", "edge_type"]
    return made.dropDuplicates(key).join(stored.select(*key), key, "left_anti")
