"""Folders of files of all kinds: each file's parser gives its records."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import strip_latex
from skein.operators.routing import CODE_EXTENSIONS
from skein.sources import readers

#: A file's records: (text, metadata) in order.
Records = Iterator[tuple[str | None, dict[str, str] | None]]


#: Records, and characters of their texts, that a task passes on at once.
MOST_ROWS, MOST_HELD = 1000, 1 << 20
#: Rows below the first that tell whether it is a header.
HEADER_ROWS = 21


def plain(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


def delimiter_of(sample: str) -> str:
    """The delimiter that splits the sample's lines alike, else the most frequent, else a comma."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=",\t|;").delimiter
    except csv.Error:
        return max("\t,|", key=sample.count) if any(c in sample for c in "\t,|") else ","


def is_number(cell: str) -> bool:
    try:
        complex(cell)
    except (ValueError, OverflowError):
        return False
    return True


def headed(rows: list[list[str]]) -> bool:
    """Whether the first row names the columns, by the next ``HEADER_ROWS`` of as many cells.

    A column of numbers votes for a header if its first cell is none, else against. If these votes are
    even, columns whose texts are of one length vote for it where the first cell's is another, else
    against. Without a vote there is none, so that no row is lost.
    """
    first, rest = rows[0], [r for r in rows[1 : HEADER_ROWS + 1] if len(r) == len(rows[0])]
    numbers = texts = 0
    for name, *cells in zip(first, *rest, strict=True) if rest else ():
        if all(map(is_number, cells)):
            numbers += -1 if is_number(name) else 1
        elif not any(map(is_number, cells)) and len(set(map(len, cells))) == 1:
            texts += -1 if len(name) == len(cells[0]) else 1
    return numbers > 0 or (numbers == 0 and texts > 0)


def table_records(text: str, title: str) -> Records:
    """The rows of a table of unknown form as ``Context: title | Columns: [..] | Data: name: cell | ..``.

    Rows may be ragged: further columns are ``Extra_Col_i``; without a header names are ``Col_i``. Cells
    are trimmed, empty ones left out; of columns of one name the last counts. Empty lines are skipped.
    """
    sample = text[:8192]
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter_of(sample)) if r]
    if not rows:
        return
    names, body = (rows[0], rows[1:]) if headed(rows) else ([f"Col_{i}" for i in range(len(rows[0]))], rows)
    names = names + [f"Extra_Col_{i}" for i in range(len(names), max(map(len, rows)))]
    for row in body:
        cells = {name: cell.strip() for name, cell in zip(names, row, strict=False)}
        filled = " | ".join(f"{name}: {cell}" for name, cell in cells.items() if cell)
        yield f"Context: {title} | Columns: [{', '.join(names)}] | Data: {filled}", None


def looks_tabular(text: str) -> bool:
    """Over 1.5 tabs or 2 commas a line in the first 2048 characters, and more than one line."""
    head = text[:2048]
    lines = len(head.strip().split("\n"))
    return lines > 1 and (head.count("\t") / lines > 1.5 or head.count(",") / lines > 2.0)


def smart_records(data: bytes, title: str, exact: bool = False) -> Records:
    """A text that looks like a table gives its rows, any other itself."""
    text = plain(data)
    if looks_tabular(text):
        yield from table_records(text, title)
    elif exact or text:
        yield text, None


def json_record(item: object, exact: bool = False) -> tuple[str | None, dict[str, str]] | None:
    """(text, metadata) as ``readers.json_documents`` gives them; None for what is no object. A null in
    place of the text is the text if ``exact``."""
    if not isinstance(item, dict):
        return None
    said = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in item.items() if v is not None}
    null = exact and any(k in item for k in ("text", "content"))
    text = said.get("text", said.get("content", None if null else json.dumps(item, ensure_ascii=False)))
    return text, {k: v for k, v in said.items() if k not in ("text", "content")}


def json_records(data: bytes, title: str, exact: bool = False) -> Records:
    found = json.loads(plain(data))
    yield from filter(None, (json_record(item, exact) for item in (found if isinstance(found, list) else [found])))


def json_line_records(data: bytes, title: str, exact: bool = False) -> Records:
    """Malformed lines are left out."""
    for line in plain(data).split("\n"):
        try:
            record = json_record(json.loads(line), exact) if line.strip() else None
        except ValueError:
            continue
        if record:
            yield record


def notebook_records(data: bytes, title: str, exact: bool = False) -> Records:
    """Non-empty cells, all if ``exact``; code cells are fenced."""
    for cell in json.loads(plain(data)).get("cells", []):
        source = cell.get("source", "")
        body = "".join(source) if isinstance(source, list) else source
        if exact or (body and body.strip()):
            yield (f"```python\n{body or ''}\n```" if cell.get("cell_type") == "code" else body), None


def statement_records(data: bytes, title: str) -> Records:
    """Statements; they end at ``;`` before a line end, pure comments go."""
    for part in re.split(r";\s*(?:\n|$)", plain(data)):
        if part.strip() and not part.strip().startswith("--"):
            yield part.strip(), None


def sheet_records(data: bytes, title: str, exact: bool = False) -> Records:
    for sheet, _, header, cells in readers.workbook_rows(data):
        yield readers.row_line(f"{title}[{sheet}]", header, cells, exact), {"sheet": sheet}


def chapter_records(data: bytes, title: str, exact: bool = False) -> Records:
    for name, text in readers.epub_chapters(data, readers.WHITE if exact else None):
        if exact or (text and text.strip()):
            yield text if exact else text.strip(), {"item_name": name}


def parquet_records(data: bytes, title: str) -> Records:
    import pyarrow.parquet as pq

    for batch in pq.ParquetFile(io.BytesIO(data)).iter_batches():
        for row in batch.to_pylist():
            yield readers.row_line(title, list(row), ["" if v is None else str(v) for v in row.values()]), None


def one_record(parse: Callable[[bytes], str], exact: bool = False) -> Callable[[bytes, str], Records]:
    def records(data: bytes, title: str) -> Records:
        text = parse(data)
        if exact or text:
            yield text, None

    return records


#: Extension to (kind, parser of a file's bytes and base name).
PARSERS: dict[str, tuple[str, Callable[[bytes, str], Records]]] = {
    **{e: ("code", one_record(plain)) for e in CODE_EXTENSIONS},
    **{e: (e, one_record(readers.PARSERS[e])) for e in ("html", "htm", "xml", "eml", "rtf", "docx", "pptx")},
    **{e: ("table", lambda data, title: table_records(plain(data), title)) for e in ("csv", "tsv")},
    **{e: ("jsonl", json_line_records) for e in ("jsonl", "ndjson")},
    "txt": ("text", smart_records),
    "md": ("text", one_record(plain)),
    "tex": ("latex", one_record(plain)),
    "json": ("json", json_records),
    "ipynb": ("notebook", notebook_records),
    "sql": ("sql", statement_records),
    "xlsx": ("excel", sheet_records),
    "epub": ("epub", chapter_records),
    "parquet": ("parquet", parquet_records),
}
#: Parsers that lose no text: blank files, cells, paragraphs and pages are records, and only ``readers.WHITE`` is stripped.
EXACT: dict[str, tuple[str, Callable[[bytes, str], Records]]] = PARSERS | {
    **{e: (kind, one_record(plain, True)) for e, (kind, _) in PARSERS.items() if kind in ("code", "latex") or e == "md"},
    **{e: (e, one_record(lambda data: readers.visible_text(data.decode("utf-8", "replace"), readers.WHITE), True)) for e in ("html", "htm")},
    "xml": ("xml", one_record(partial(readers.xml_text, exact=True), True)),
    "eml": ("eml", one_record(partial(readers.mail_text, white=readers.WHITE), True)),
    "rtf": ("rtf", one_record(partial(readers.rtf_text, white=readers.WHITE), True)),
    "docx": ("docx", one_record(readers.zipped_xml_text(r"word/document\.xml", "}p", True), True)),
    "pptx": ("pptx", one_record(readers.zipped_xml_text(r"ppt/slides/slide\d+\.xml", "}p", True), True)),
    **{e: ("jsonl", partial(json_line_records, exact=True)) for e in ("jsonl", "ndjson")},
    "txt": ("text", partial(smart_records, exact=True)),
    "json": ("json", partial(json_records, exact=True)),
    "ipynb": ("notebook", partial(notebook_records, exact=True)),
    "xlsx": ("excel", partial(sheet_records, exact=True)),
    "epub": ("epub", partial(chapter_records, exact=True)),
}
#: Kinds whose texts do not name their file: data of tables, and code, which must stay parseable.
BARE = ("excel", "parquet", "code", "image")


def parse_files(
    files: DataFrame,
    root: str = "",
    parsers: dict[str, tuple[str, Callable[[bytes, str], Records]]] | None = None,
    most_bytes: int = readers.MOST_BYTES,
    exact: bool = False,
) -> DataFrame:
    """(id, text, source, kind, row, metadata, error): the records of ``files`` (path, content).

    The extension chooses the parser; files without one are left out. Texts begin with ``[File Path:
    path below root]`` but for the kinds in ``BARE``. A file that cannot be read, is over ``most_bytes``
    or holds no record is one row with null text and its error, after the records that it gave before;
    others go on. ``parsers`` adds to ``PARSERS``, or with ``exact`` to ``EXACT``, whose records may be blank. Null paths
    are left out; null contents are empty files, or with ``exact`` a record of null text.
    """
    known = (EXACT if exact else PARSERS) | (parsers or {})
    schema = "source string, kind string, row long, text string, metadata map<string,string>, error string"

    def records(source: str, data: bytes | None) -> Iterator[tuple]:
        kind, parse = known[source.rsplit(".", 1)[-1].lower()]
        row = 0
        if exact and data is None:
            yield source, kind, row, None, None, None
            return
        try:
            for text, metadata in parse(bytes(data or b""), readers.basename_of(source)):
                yield source, kind, row, text, metadata, None
                row += 1
            if not row:
                yield source, kind, None, None, None, "no records"
        except Exception as problem:  # one file's fault is not the others'
            yield source, kind, None, None, None, f"{type(problem).__name__}: {problem}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split(" ")[0] for part in schema.split(", ")]
        rows, held = [], 0
        for batch in batches:
            for source, data in zip(batch["path"], batch["content"], strict=True):
                for row in records(source, data):
                    rows.append(row)
                    held += len(row[3] or "")
                    if held > MOST_HELD or len(rows) == MOST_ROWS:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names, dtype=object)

    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.where(extension.isin(*known))
    size = F.col("length") if "length" in files.columns else F.coalesce(F.octet_length("content"), F.lit(0))
    rows = named.where(size <= most_bytes).select("path", "content").mapInPandas(read, schema)
    kinds = F.create_map(*[F.lit(x) for e, (kind, _) in known.items() for x in (e, kind)])
    void = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("text", "string"), ("metadata", "map<string,string>"))]
    over = named.where(size > most_bytes).select(F.col("path").alias("source"), kinds[extension].alias("kind"), *void, F.lit("file too large").alias("error"))
    base = root.rstrip("/") + "/" if root else ""
    below = F.col("source")
    if base:
        at = F.instr("source", base)
        below = F.when(at > 0, F.substr("source", at + len(base))).otherwise(below)
    said = F.when(F.col("kind") == "latex", strip_latex(F.col("text"))).otherwise(F.col("text"))
    text = F.when(F.col("kind").isin(*BARE), said).otherwise(F.concat(F.lit("[File Path: "), below, F.lit("]\n"), said))
    return readers.with_id(rows.unionByName(over).withColumn("text", text))


def folder_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """``parse_files`` of all files under ``path``; Spark's listing leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_files(files, path, **options)
