"""Column functions over text, tokens, vectors and hashes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that texts do not hold; sentence ends are turned to it before a split.
MARK = "\u241e"


def tokens(text: Column) -> Column:
    """Lower-cased words, split at white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def clean_tokens(text: Column) -> Column:
    """Distinct lower-cased words without punctuation."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return F.array_distinct(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))


def normalize_space(text: Column) -> Column:
    """White space in a row becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def doc_hash(text: Column) -> Column:
    return F.md5(text)


def trimmed_sha256(text: Column) -> Column:
    return F.sha2(F.trim(text), 256)


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before white space; a piece of under ``least``
    characters joins the one before it."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", f"$1{MARK}")
    pieces = F.filter(
        F.transform(F.split(marked, MARK), lambda s: F.trim(s)), lambda s: s != ""
    )
    empty = F.array().cast("array<string>")

    def add(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        merged = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", last, piece))
        )
        short = (F.length(piece) < least) & (F.size(done) > 0)
        return F.when(short, merged).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, empty, add)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; the shorter length counts."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def word_in(text: Column, word: str) -> Column:
    """Whether ``word`` occurs between characters other than ASCII letters and digits."""
    import re

    return text.rlike(rf"(?i)(?<![0-9A-Za-z]){re.escape(word)}(?![0-9A-Za-z])")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def strip_tags(html: Column) -> Column:
    """Text of markup by regular expressions: for fragments, not whole pages."""
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return normalize_space(F.regexp_replace(visible, r"(?s)<[^>]*>", " "))


def strip_latex(tex: Column) -> Column:
    """Comments, preamble, floats and commands go; the text of unwrapped commands stays."""
    steps = (
        (r"(?m)(?<!\\)%.*$", ""),
        (r"(?s)^.*?\\begin\{document\}|\\end\{document\}.*$", ""),
        (r"(?s)\\begin\{(figure|table|equation|align|tikzpicture)\*?\}.*?\\end\{\1\*?\}", " "),
        (r"\\(cite|ref|label|includegraphics|bibliography)[a-z]*(\[[^\]]*\])?\{[^}]*\}", ""),
        (r"\\[A-Za-z]+\*?(\[[^\]]*\])?\{([^{}]*)\}", "$2"),
        (r"\\[A-Za-z]+\*?", ""),
    )
    for pattern, put in steps:
        tex = F.regexp_replace(tex, pattern, put)
    return normalize_space(tex)


def github_raw(url: Column) -> Column:
    """Raw address of a file or gist page; folders have none and raise an error."""
    blob = r"^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$"
    gist = r"^https?://gist\.github\.com/([^/]+)/([0-9a-f]+)/?$"
    tree = r"^https?://github\.com/[^/]+/[^/]+/tree/.*$"
    return (
        F.when(url.rlike(blob), F.regexp_replace(url, blob, r"https://raw.githubusercontent.com/$1/$2/$3"))
        .when(url.rlike(gist), F.regexp_replace(url, gist, r"https://gist.githubusercontent.com/$1/$2/raw"))
        .when(url.rlike(tree), F.raise_error(F.lit("a folder has no raw address")).cast("string"))
        .otherwise(url)
    )


def html_escape(text: Column) -> Column:
    """Markup characters and quotes as references, the ampersand first."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def relation_words(relation: Column) -> Column:
    """WORKS_FOR as ``works for``."""
    return F.lower(F.replace(relation, F.lit("_"), F.lit(" ")))


def seeded(key: Column, seed: int) -> Column:
    """A number that stands for a place in an order drawn by ``seed``."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("long")
