"""Splitters: documents to chunks, one row each with its lineage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.batches import text_slices

# fixed values: abbreviations that do not end a sentence
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "rev", "st", "gen", "rep", "sen", "ph.d", "m.d", "b.a", "m.a", "b.s", "m.s",
    "e.g", "i.e", "etc",
)
SENTENCE_END = re.compile(r"([.!?]+)\s+")


def estimate(text: str) -> int:
    return len(text) // 4


def split_sentences(text: str) -> list[str]:
    """Pieces up to marks ``.!?`` before white space; a piece whose last word is an abbreviation
    goes on with the next. Marks with nothing before them are dropped."""
    text = text.strip()
    ends = [(m.start(), m.end(1), m.end()) for m in SENTENCE_END.finditer(text)]
    out: list[str] = []
    held: list[str] = []
    start = 0
    for stop, marks, after in [*ends, (len(text),) * 3]:
        body = text[start:stop].strip()
        start = after
        if body:
            held.append(body + text[stop:marks])
            if body.split()[-1].lower() not in ABBREVIATIONS:
                out.append(" ".join(held))
                held = []
    return out + ([" ".join(held)] if held else [])


def semantic(text: str, size: int = 1000, overlap: int = 200, length: Callable = estimate) -> list[str]:
    """Sentences packed in order up to ``size`` tokens; a chunk starts with the last sentences of
    the one before, up to ``overlap`` tokens. A longer sentence is a chunk of its own."""
    chunks, current, total = [], [], 0
    for sentence in split_sentences(text):
        n = length(sentence)
        if current and total + n > size:
            chunks.append(" ".join(current))
            kept, carried = [], 0
            for s in reversed(current):
                if carried + length(s) > overlap or n + carried + length(s) > size:
                    break
                kept.insert(0, s)
                carried += length(s)
            current, total = kept, carried
        current.append(sentence)
        total += n
    return chunks + ([" ".join(current)] if current else [])


def recursive(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """Windows of ``size`` characters that end after their last paragraph end, or if they have
    none their last line end, or else word end; where that lies within the overlap, at the full
    size. The next window starts ``overlap`` characters before the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("needs size > 0 and 0 <= overlap < size")
    out, start = [], 0
    while len(text) - start > size:
        end = start + size
        found = ((text.rfind(mark, start, end), len(mark)) for mark in ("\n\n", "\n", " "))
        at = next((i + n for i, n in found if i >= 0), -1)
        if at <= start + overlap:
            at = end
        out.append(text[start:at].strip())
        start = at - overlap
    out.append(text[start:].strip())
    return [c for c in out if c]


def markdown(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Sections by heading; a larger one is split semantically, each part under its heading."""
    out = []
    for section in re.split(r"(?:^|\n)(?=#{1,6} )", text):
        section = section.strip()
        if not section:
            continue
        if estimate(section) <= size:
            out.append(section)
            continue
        heading = section.split("\n", 1)[0] if section.startswith("#") else ""
        for i, part in enumerate(semantic(section, size, overlap)):
            out.append(f"{heading}\n{part}" if i and heading else part)
    return out


def code(text: str, size: int = 4000) -> list[str]:
    """Top-level blocks, packed up to ``size`` characters; a larger block is cut at line ends."""
    starts = r"(?m)^(?=(?:def|class|async def|func|fn|pub|impl|function|interface|struct|enum|package|@)\b?)"
    out, current = [], ""
    for block in re.split(starts, text):
        if current and len(current) + len(block) > size:
            out.append(current)
            current = ""
        current += block
        while len(current) > size:
            at = current.rfind("\n", 1, size)
            at = at + 1 if at > 0 else size
            out.append(current[:at])
            current = current[at:]
    return [c for c in [*out, current] if c.strip()]


SPLITTERS = {"semantic": semantic, "recursive": recursive, "markdown": markdown, "code": code}


def chunk(docs: DataFrame, splitter: str = "semantic", id_col: str = "id", text_col: str = "text", **options) -> DataFrame:
    """(source_id, chunk_index, id, chunk, total_chunks); null and blank texts give no chunks. A worker
    cuts texts of a bounded size at once."""
    cut = SPLITTERS[splitter]

    rows = docs.select(F.col(id_col).alias("source_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["source_id"], T.StructField("parts", T.ArrayType(T.StringType()))])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            parts = [cut(t, **options) if t else [] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["source_id"], pa.array(parts, pa.list_(pa.string()))], names=schema.names)

    split = rows.mapInArrow(pieces, schema)
    return fan_out(split, F.col("parts"))


def fan_out(docs: DataFrame, parts: Column) -> DataFrame:
    rows = docs.select("source_id", F.size(parts).alias("total_chunks"), F.posexplode(parts).alias("chunk_index", "chunk"))
    name = F.concat(F.col("source_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index"))
    return rows.select("source_id", "chunk_index", name.alias("id"), "chunk", "total_chunks")


def fixed_windows(docs: DataFrame, size: int = 1000, step: int = 800, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Windows of ``size`` characters every ``step``, in columns alone; no window past the end."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    parts = F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))
    split = docs.where(F.length(text) > 0).select(F.col(id_col).alias("source_id"), parts.alias("parts"))
    return fan_out(split, F.col("parts"))


def with_parents(docs: DataFrame, parent_size: int = 1500, child_size: int = 300, **columns) -> DataFrame:
    """Child chunks with the id of their parent chunk; the parents' texts are joined when needed."""
    parents = chunk(docs, "recursive", size=parent_size, overlap=0, **columns)
    name = F.concat(F.col("source_id").cast("string"), F.lit("_p"), F.col("chunk_index"))
    parents = parents.select(name.alias("id"), F.col("chunk").alias("text"))
    return chunk(parents, "recursive", size=child_size, overlap=0).withColumnRenamed("source_id", "parent_id")


def similarity_breaks(sentences: DataFrame, threshold: float = 0.5, most: int | None = None) -> DataFrame:
    """Groups sentences (doc, idx, embedding, and with ``most`` their length): a new group where
    the cosine with the sentence before falls under ``threshold``, or where the group would get
    longer than ``most``. A document's sentences are folded in order, in one row a document."""
    from skein.functions.text import cosine

    order = Window.partitionBy("doc").orderBy("idx")
    before = F.lag("embedding").over(order)
    starts = F.when(before.isNull() | (cosine(before, F.col("embedding")) < threshold), 1).otherwise(0)
    marked = sentences.withColumn("_start", starts)
    if most is None:
        return marked.withColumn("group", F.sum("_start").over(order)).drop("_start")
    items = F.array_sort(F.collect_list(F.struct("idx", "_start", F.col("length").cast("long").alias("n"))))
    zero = F.struct(
        F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("groups")
    )

    def step(state: Column, item: Column) -> Column:
        new = (item["_start"] == 1) | (state["total"] + item["n"] > most)
        group = state["group"] + new.cast("long")
        total = F.when(new, item["n"]).otherwise(state["total"] + item["n"])
        return F.struct(group.alias("group"), total.alias("total"), F.concat(state["groups"], F.array(group)).alias("groups"))

    folded = marked.groupBy("doc").agg(items.alias("items")).withColumn("groups", F.aggregate("items", zero, step)["groups"])
    told = folded.select("doc", F.explode(F.arrays_zip(F.transform("items", lambda x: x["idx"]).alias("idx"), "groups")).alias("z"))
    told = told.select("doc", F.col("z.idx").alias("idx"), F.col("z.groups").alias("group"))
    return sentences.join(told, ["doc", "idx"])


#: Sentences that a model embeds at once.
MODEL_BATCH = 512


def semantic_breaks(before: np.ndarray, vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each sentence is unlike the one before it (``before`` for the first)."""
    rows = np.vstack([before, vectors])
    norms = np.sqrt((rows * rows).sum(axis=1))
    return (rows[:-1] * rows[1:]).sum(axis=1) / (norms[:-1] * norms[1:] + 1e-9) < threshold


def cosine_chunks(
    docs: DataFrame,
    model: Callable[[list[str]], np.ndarray],
    threshold: float = 0.5,
    most: int = 1000,
    id_col: str = "id",
    text_col: str = "text",
    length: Callable[[str], int] = estimate,
) -> DataFrame:
    """(source_id, chunk_index, id, chunk, total_chunks): sentences in a row that stay on a subject.

    ``model`` embeds a list of sentences, one row each. A chunk ends where the cosine of two
    sentences that follow one another falls under ``threshold``, or where it would get longer
    than ``most`` by ``length``. One pass where the texts lie: the sentences of a batch of texts are
    embedded MODEL_BATCH at a time, across texts; breaks are folded text by text with what the
    open chunk holds carried on, so no document's sentences are gathered by Spark.

    A text of one sentence is one chunk, as it is; null and blank texts give none. Repeated rows
    repeat their chunks. The model is called in the workers and must be deterministic for a lost
    task to give the same chunks.
    """
    rows = docs.select(F.col(id_col).alias("source_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["source_id"], T.StructField("parts", T.ArrayType(T.StringType()))])

    def fold(sentences: list[str], vectors: np.ndarray) -> list[str]:
        starts = [True, *semantic_breaks(vectors[0], vectors[1:], threshold).tolist()]
        chunks: list[list[str]] = []
        held = 0
        for sentence, new in zip(sentences, starts, strict=True):
            n = length(sentence)
            if new or held + n > most:
                chunks.append([])
                held = 0
            chunks[-1].append(sentence)
            held += n
        return [" ".join(c) for c in chunks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            cut = [split_sentences(t) for t in texts]
            several = [s for s in cut if len(s) > 1]
            flat = [x for s in several for x in s]
            vectors = [np.asarray(model(flat[i : i + MODEL_BATCH]), np.float64) for i in range(0, len(flat), MODEL_BATCH)]
            told = np.concatenate(vectors) if vectors else np.zeros((0, 1))
            at, parts = 0, []
            for text, sentences in zip(texts, cut, strict=True):
                if len(sentences) > 1:
                    parts.append(fold(sentences, told[at : at + len(sentences)]))
                    at += len(sentences)
                else:
                    parts.append([text] if text.strip() else [])
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), pa.array(parts, pa.list_(pa.string()))], names=schema.names)

    return fan_out(rows.mapInArrow(run, schema), F.col("parts"))
