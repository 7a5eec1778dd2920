"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import ascii_lower, fresh_name
from skein.session import cut_lineage

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Clashing hashes that a plan lists; more of them are joined.
MOST_CLASHES = 1000


def chunk_pattern(min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> str:
    """A chunk ends at the first sentence end past ``min_chunk`` characters, else at ``max_chunk``.

    Where it ends depends on the text around the end alone, so equal stretches of two texts fall
    back into equal chunks after a difference.
    """
    return rf"(?s).{{{min_chunk},{max_chunk}}}?(?<=[.!?;]\s)|.{{1,{max_chunk}}}"


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chunk: int = MIN_CHUNK,
    max_chunk: int = MAX_CHUNK,
    chunk_hash=F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A text is cut into content-defined
    chunks. The dictionary of distinct chunks, the only step that moves text (each distinct chunk
    of a task once), verifies the identifiers: a ``chunk_hash`` that stands for one chunk text is
    that chunk's identifier, and a chunk whose hash stands for several is identified by its own
    text. Documents are then compared by their ordered lists of identifiers, a few bytes a chunk.

    Of equal texts the row with the largest id stays. Null text counts as empty, and empty texts
    are equal. Rows that repeat the staying id are the same document and stay with it. A group
    whose ids are all null has a null keep_id and all its rows stay. Other columns are ignored.

    ``chunk_hash`` may be any hash of a column; weak ones only cost time. Clashes of a 64-bit hash
    are expected about n*n/2**65 times for n chunks: 70 among the chunks of 100 TB. Up to
    MOST_CLASHES of them are put into the plan; where a weak hash has more, a join tells the texts
    that hold a clashing chunk, and such a text's chunks are all identified by themselves. Equal
    texts get equal recipes either way. Runs one job when called and writes the recipes (not the texts)
    to the checkpoint folder.
    """
    pattern = F.lit(chunk_pattern(min_chunk, max_chunk))
    texts = docs.select(
        F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t")
    )
    pieces = F.regexp_extract_all("_t", pattern, F.lit(0))

    dictionary = (
        texts.select(F.explode(pieces).alias("chunk"))
        .select(chunk_hash("chunk").alias("h"), "chunk")
        .distinct()
    )
    clashing = dictionary.groupBy("h").count().where("count > 1").select("h")
    few = [row.h for row in clashing.limit(MOST_CLASHES + 1).collect()]
    if len(few) > MOST_CLASHES:  # a weak hash: which rows hold a clashing chunk is told by a join
        clashing = cut_lineage(clashing)
        held = texts.select(
            F.xxhash64("_t").alias("k"), F.explode(F.array_distinct(F.transform(pieces, chunk_hash))).alias("h")
        )
        held = held.join(clashing, "h", "left_semi").select("k").distinct()
        texts = texts.withColumn("k", F.xxhash64("_t")).join(held.withColumn("clash", F.lit(True)), "k", "left")
        clash = F.coalesce("clash", F.lit(False))
    else:
        clash = None

    def identifier(chunk: Column) -> Column:
        h = chunk_hash(chunk)
        if not few:
            return h
        own_text, by_hash = F.concat(F.lit("text:"), chunk), F.concat(F.lit("hash:"), h.cast("string"))
        return F.when(h.isin(few) if clash is None else clash, own_text).otherwise(by_hash)

    recipes = cut_lineage(
        texts.select(
            "_id", F.transform(pieces, identifier).alias("recipe"), F.sha2("_t", 256).alias("sha")
        )
    )
    # Copies meet as partial counts, one row per task and recipe. The second join key makes the
    # join deal both sides anew, which lets AQE split the partition of a hot recipe.
    groups = recipes.groupBy("recipe").agg(
        F.max("_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.first("sha").alias("sha"),
    )
    return recipes.join(groups, ["recipe", "sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a repeated row stays once."""
    keep, sha, rows, own_sha = (fresh_name(docs, x) for x in ("_keep", "_sha", "_rows", "_text_sha"))
    text_hash = F.sha2(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 256)
    kept = (
        exact_dedup(docs, id_col, text_col)
        .where("kept")
        .groupBy(F.col(f"`{id_col}`").alias(keep), F.col("text_sha256").alias(sha))
        .agg(F.count(F.lit(1)).alias(rows))
    )
    own = docs.withColumn(own_sha, text_hash)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(keep)) & (F.col(own_sha) == F.col(sha))
    found = own.join(kept, same)
    # Only rows that repeat are dealt once more; all others have moved once.
    once = found.where(F.col(rows) == 1)
    repeated = found.where(F.col(rows) > 1).dropDuplicates([id_col, own_sha])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
