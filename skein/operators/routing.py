"""Predicates and classifiers over queries and documents, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import basename

# fixed values: keywords of the query routes
HOLISTIC = (
    "summarize", "summary", "overview", "all", "every", "compare", "list all", "across", "throughout",
    "entire", "whole", "global", "what are all", "how many", "count", "trend", "pattern", "themes",
    "main topics",
)
SYNTHESIS = (
    "summarize", "overview", "compare", "contrast", "explain", "discuss", "survey", "themes", "analysis",
)
TABLE = (
    "table", "row", "column", "value", "count", "average", "maximum", "minimum", "statistic", "how many",
    "list all",
)
ENTITY = (
    "relationship", "related to", "who", "works with", "connected", "linked", "colleague", "dependency",
    "relate",
)
CORPUS = ("all documents", "entire corpus", "everything", "main topics", "key themes", "across all")

# fixed values: extensions and file names that tell what a document is
CODE_EXTENSIONS = (
    "py", "ts", "js", "go", "rs", "java", "cpp", "c", "h", "hpp", "sh", "bash", "zsh", "rb", "pl", "pm",
    "jl", "kt", "swift", "jsx", "tsx", "cs", "php", "scala",
)
#: of these, those that mark a query as one about code
QUERY_EXTENSIONS = ("py", "go", "rs", "ts", "js", "sh", "rb", "jl", "cpp", "c", "java", "kt")
MANIFESTS = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt",
    "requirements-dev.txt", "pipfile", "pipfile.lock", "pyproject.toml", "setup.cfg", "setup.py",
    "cargo.toml", "cargo.lock", "go.mod", "go.sum", "composer.json", "composer.lock", "gemfile",
    "gemfile.lock", "podfile", "podfile.lock", ".gitmodules", "cmakelists.txt", "makefile", "dockerfile",
)
# fixed values: paths of reference pages, lines and words that tell code, papers and notes
REFERENCE = ("/api/", "/apidocs/", "/api-docs/", "/swagger/", "/openapi/", "/reference/", "/javadoc/", "/doxygen/")
CODE_LINE = r"^(def |class |import |from |fn |func |//|#!|public |private |protected |package |using |namespace )"
PAPER = r"\b(Abstract|Introduction|References|DOI|arXiv|Figure \d|Conclusion|Methodology)\b"
DOC = r"(?m)(^#{1,3} |\*\*\w|\bChapter\b|\bNote:\b|\bStep \d|^\d+\.\s)"
# fixed values: words of a query about code
SYMBOL_WORDS = ("function", "class", "method", "def", "module", "import", "variable", "struct", "interface", "enum")

#: (summaries, graph) allowed by dataset type; others get both
SOURCE_POLICY = {
    "paper": (True, True),
    "doc": (True, True),
    "knowledge": (False, False),
    "discussion": (False, True),
    "codebase": (False, False),
    "manifest": (False, False),
    "reference": (False, False),
}


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"\b(" + "|".join(map(re.escape, words)) + r")\b")


def query_route(query: Column) -> Column:
    """corpus_exploration, entity_relation, table_lookup, synthesis or factual."""
    q, n = F.lower(query), F.length(query)
    return (
        F.when(has_word(q, CORPUS) | ((n > 120) & has_word(q, SYNTHESIS)), "corpus_exploration")
        .when(has_word(q, ENTITY), "entity_relation")
        .when(has_word(q, TABLE), "table_lookup")
        .when(has_word(q, SYNTHESIS) | (n > 80), "synthesis")
        .otherwise("factual")
    )


def needs_graph(query: Column) -> Column:
    """A holistic keyword anywhere, or over 20 words."""
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return F.lower(query).rlike("|".join(map(re.escape, HOLISTIC))) | (words > 20)


def looks_like_code(query: Column) -> Column:
    """camelCase, snake_case, a file extension or a symbol word."""
    extension = r"\.(" + "|".join(QUERY_EXTENSIONS) + ")"
    symbol = r"(?i)(^|\s)(" + "|".join(SYMBOL_WORDS) + r")(\s|$)"
    return query.rlike("[a-z][A-Z]") | query.rlike("[a-z]_[a-z]") | query.rlike(extension) | query.rlike(symbol)


def code_tokens(query: Column) -> Column:
    """Lower-cased file stems, qualified names and their parts, identifiers of 4 or more
    characters, and camel and snake parts of 3 or more."""
    extension = "|".join(QUERY_EXTENSIONS)
    stems = F.regexp_extract_all(query, F.lit(rf"\b(\w+)\.(?:{extension})\b"), F.lit(1))
    names = F.regexp_extract_all(query, F.lit(r"\b([A-Za-z_]\w+\.[A-Za-z_]\w+)\b"), F.lit(1))
    parts = F.flatten(F.transform(names, lambda n: F.split(n, r"\.")))
    words = F.regexp_extract_all(query, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]{3,})\b"), F.lit(1))
    camel = F.flatten(
        F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(r"([A-Z][a-z0-9]*|[a-z][a-z0-9]*)"), F.lit(1)))
    )
    snake = F.flatten(F.transform(F.filter(words, lambda w: F.contains(w, F.lit("_"))), lambda w: F.split(w, "_")))
    pieces = F.filter(F.concat(camel, snake), lambda p: F.length(p) >= 3)
    return F.array_distinct(F.transform(F.concat(stems, names, parts, words, pieces), lambda t: F.lower(t)))


def dataset_type(text: Column, source: Column) -> Column:
    """(type, has_code) of a document by its source's name, then by its content."""
    source = F.lower(F.regexp_replace(F.coalesce(source, F.lit("")), r"\\", "/"))
    text = F.coalesce(text, F.lit(""))
    extension = F.regexp_extract(basename(source), r".\.([^.]+)$", 1)
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    n = F.size(lines)
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    tabs = F.length(text) - F.length(F.replace(text, F.lit("\t"), F.lit("")))
    code = F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(CODE_LINE)))
    code_ratio = F.when(n > 0, code / n).otherwise(F.lit(0.0))
    start = F.trim(F.substring(text, 1, 2000))
    talk = start.rlike(r'^[\[{]') & reduce(
        Column.__or__,
        [F.get_json_object(start, f"{at}.{k}").isNotNull() for at in ("$", "$[0]") for k in ("role", "turn", "messages", "speaker")],
    )
    fenced = text.contains("```") | text.contains("    def ") | text.contains("    class ")
    papers = F.size(F.regexp_extract_all(F.substring(text, 1, 2000), F.lit(PAPER), F.lit(1)))

    def kind(name: str, has_code: Column | bool = False) -> Column:
        flag = has_code if isinstance(has_code, Column) else F.lit(has_code)
        return F.struct(F.lit(name).alias("type"), flag.alias("has_code"))

    return (
        F.when(extension.isin(*CODE_EXTENSIONS), kind("codebase"))
        .when(basename(source).isin(*MANIFESTS) | extension.isin("lock", "sum"), kind("manifest"))
        .when(source.rlike("|".join(map(re.escape, REFERENCE))), kind("reference"))
        .when(talk, kind("discussion"))
        .when(n == 0, kind("doc"))
        .when((commas / n > 2.0) | (tabs / n > 1.5), kind("knowledge"))
        .when((code_ratio > 0.15) & (code_ratio < 0.5), kind("doc", True))
        .when(code_ratio >= 0.5, kind("codebase"))
        .when(papers >= 2, kind("paper"))
        .when(F.substring(text, 1, 3000).rlike(DOC), kind("doc", fenced))
        .otherwise(kind("doc"))
    )


def splitter_for(kind: Column, has_code: Column, source: Column) -> Column:
    """(splitter, size, overlap) for a document of a type."""

    def choice(name: str, size: int, overlap: int) -> Column:
        return F.struct(F.lit(name).alias("splitter"), F.lit(size).alias("size"), F.lit(overlap).alias("overlap"))

    return (
        F.when(kind == "codebase", choice("code", 4000, 800))
        .when(kind == "paper", choice("semantic", 600, 100))
        .when(kind == "discussion", choice("recursive", 300, 30))
        .when(kind == "knowledge", choice("semantic", 400, 50))
        .when((kind == "doc") & has_code, choice("semantic", 500, 75))
        .when(F.lower(source).endswith(".md"), choice("markdown", 1000, 200))
        .otherwise(choice("semantic", 1000, 200))
    )
