"""Queries that split: source files made of parts by symbol, documents where their subject changes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import codegraph, codesplit
from skein.operators.chunking import cosine_chunks
from skein.plans.registry import registry, table

QUERIES, query = registry()

#: A part with an even key is a Python file, one with an odd key a Go file. ``{...}`` are columns.
PYTHON = """import src.kind{size}
from os import path

TEXT = "def no(): pass"


@cached
def {name}(a, b={size}):
    \"\"\"{plain}.\"\"\"
    return a + b


class Part{key}(Base, kind={size}):
    def test_size(self):
        return {size}


async def test_{name}(*args):
    await {name}(1)


if __name__ == "__main__":
    {name}(1)
"""
GO = """package parts

import "fmt"

type Part{key} struct {
	size int
}

func {name}(a int) int {
	// func no() {}
	return a + {size}
}

func main() {
	fmt.Println({size})
}
"""


def filled(template: str) -> F.Column:
    """A template with the columns of a part in its places."""
    columns = {"key": F.col("p_partkey").cast("string"), "size": F.col("p_size").cast("string"), "name": F.replace("p_name", F.lit(" "), F.lit("_")), "plain": F.col("p_name")}
    text = F.lit(template)
    for name, column in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), column)
    return text


#: Files that one task makes and splits, about.
TASK_FILES = 20_000


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    path = F.concat(F.lit("src/part"), F.col("p_partkey").cast("string"), F.when(even, ".py").otherwise(".go"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    rows = rows.repartition(1 + rows.count() // TASK_FILES, "p_partkey")  # a text is many times its row
    return rows.select(
        F.col("p_partkey").alias("id"), path.alias("file_path"), F.when(even, filled(PYTHON)).otherwise(filled(GO)).alias("text")
    )


def symbol_sql(lines: str, index: int, kind: str, name: str, signature: str, start: int, end: int, doc: bool, entry: bool, test: bool, qualified: str | None = None) -> str:
    return f"""SELECT id, {index} AS chunk_index, '{kind}' AS symbol_type, {name} AS symbol_name, {qualified or name} AS qualified_name,
  {signature} AS signature, {start} AS start_line, {end} AS end_line, {doc} AS has_docstring, {entry} AS is_entrypoint, {test} AS is_test,
  array_to_string(list_slice(string_split(text, chr(10)), {start}, {end}), chr(10)) AS chunk FROM {lines}"""


def template_sql(template: str) -> str:
    text = "'" + template.replace("'", "''") + "'"
    for name, column in {"key": "CAST(p_partkey AS VARCHAR)", "size": "CAST(p_size AS VARCHAR)", "name": "replace(p_name, ' ', '_')", "plain": "p_name"}.items():
        text = f"replace({text}, '{{{name}}}', {column})"
    return text


CODE = f"""WITH py AS (SELECT p_partkey AS id, p_size AS size, replace(p_name, ' ', '_') AS name, {template_sql(PYTHON)} AS text FROM part WHERE p_partkey % 2 = 0),
go AS (SELECT p_partkey AS id, p_size AS size, replace(p_name, ' ', '_') AS name, {template_sql(GO)} AS text FROM part WHERE p_partkey % 2 = 1),
chunks AS (
{symbol_sql("py", 0, "function", "name", "concat('def ', name, '(a, b=', size, ')')", 8, 10, True, False, False)}
UNION ALL {symbol_sql("py", 1, "class", "concat('Part', id)", "concat('class Part', id, '(Base)')", 13, 15, False, False, False)}
UNION ALL {symbol_sql("py", 2, "function", "concat('test_', name)", "concat('async def test_', name, '(*args)')", 18, 19, False, False, True)}
UNION ALL {symbol_sql("py", 3, "entrypoint", "'__main__'", "'if __name__ == \"__main__\":'", 22, 23, False, True, False)}
UNION ALL {symbol_sql("go", 0, "type", "concat('Part', id)", "concat('type Part', id, ' struct {')", 5, 7, False, False, False)}
UNION ALL {symbol_sql("go", 1, "function", "name", "concat('func ', name, '(a int) int {')", 9, 12, False, False, "starts_with(name, 'test')")}
UNION ALL {symbol_sql("go", 2, "function", "'main'", "'func main() {'", 14, 16, False, True, False)}
)"""
#: A definition at the margin goes on to the next one; its text has no white space at its end.
ENDS = "CASE WHEN id % 2 = 0 OR chunk_index = 2 THEN end_line ELSE end_line + 1 END"


@query(f"{CODE} SELECT * REPLACE (CAST({ENDS} AS INTEGER) AS end_line) FROM chunks")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of files made of parts."""
    return split_files(spark, sf_dir).select(
        F.col("source_id").alias("id"), "chunk_index", "symbol_type", "symbol_name", "qualified_name", "signature", "start_line", "end_line",
        "has_docstring", "is_entrypoint", "is_test", "chunk",
    )


def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codesplit.code_chunks(files(spark, sf_dir))


@query(
    f"""{CODE}, f AS (SELECT *, concat('src/part', id, CASE WHEN id % 2 = 0 THEN '.py' ELSE '.go' END) AS file_path FROM chunks)
SELECT file_path AS node_id, 'file' AS node_type, file_path AS name, file_path, count(*) AS n_chunks FROM f GROUP BY ALL
UNION ALL SELECT concat(file_path, '::', qualified_name), symbol_type, symbol_name, file_path, count(*) FROM f GROUP BY ALL"""
)
def code_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the code graph of split files."""
    return codegraph.code_nodes(split_files(spark, sf_dir))


def word_vectors(sentences: list[str], width: int = 64) -> np.ndarray:
    """Counts of hashed words, a small model that needs no file."""
    import zlib

    out = np.zeros((len(sentences), width))
    for row, sentence in enumerate(sentences):
        for word in sentence.lower().split():
            out[row, zlib.crc32(word.encode()) % width] += 1
    return out


@query()
def cosine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut where the words of two sentences in a row differ, and at 200 tokens."""
    return cosine_chunks(table(spark, sf_dir, "documents"), word_vectors, threshold=0.2, most=200, id_col="doc_id")
