"""Readers of files into documents (id, text, source, ...), one row per file or per record."""

from __future__ import annotations

import email
import email.policy
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import basename, strip_latex
from skein.operators.ingest import table_row_text
from skein.operators.routing import CODE_EXTENSIONS


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(id, text, source): whole files, folders read recursively."""
    rows = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    )
    return with_id(rows)


def with_id(rows: DataFrame, kind: str = "") -> DataFrame:
    """An id from the source (and row) it came from."""
    parts = [F.col("source")] + ([F.col("row").cast("string")] if "row" in rows.columns else [])
    return rows.withColumn("id", F.concat(F.lit(kind), F.sha2(F.concat_ws("#", *parts), 256)))


def code_files(spark: SparkSession, path: str) -> DataFrame:
    rows = text_files(spark, path)
    wanted = F.lower(F.regexp_extract(basename(F.col("source")), r"\.([^.]+)$", 1)).isin(*CODE_EXTENSIONS)
    return with_id(rows.where(wanted).drop("id"), "code_").withColumn("type", F.lit("code"))


def delimiter(text: Column) -> Column:
    """tab, comma or none: by the mean number of each in the lines of the first 2048 characters."""
    head = F.substring(text, 1, 2048)
    lines = F.size(F.split(head, "\n"))

    def share(mark: str) -> Column:
        return (F.length(head) - F.length(F.replace(head, F.lit(mark), F.lit("")))) / lines

    return F.when((lines > 1) & (share("\t") > 1.5), "\t").when((lines > 1) & (share(",") > 2.0), ",")


def delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """(id, text, source, row): each line of a table as text, empty cells left out."""
    rows = spark.read.csv(path, sep=sep, header=header, inferSchema=False, mode="PERMISSIVE")
    return records(rows, path)


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    return records(spark.read.parquet(path), path)


def records(rows: DataFrame, title: str) -> DataFrame:
    names = rows.columns
    source = F.col("_metadata.file_path")
    text = table_row_text(names, basename_of(title))
    out = rows.select(text.alias("text"), source.alias("source"), F.monotonically_increasing_id().alias("row"))
    return with_id(out)


def basename_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def json_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, text, source, metadata): text is the record's ``text``, else ``content``, else all of
    it as JSON; the other fields are metadata. Malformed records are dropped."""
    raw = spark.read.text(path, wholetext=not lines)
    source = raw.select("value", F.col("_metadata.file_path").alias("source")).where(F.trim("value") != "")
    as_list = F.from_json("value", "array<string>")
    one = F.when(F.get_json_object("value", "$").isNotNull(), F.array("value"))
    items = source.select("source", F.posexplode(F.when(F.ltrim("value").startswith("["), as_list).otherwise(one)).alias("row", "item"))
    whole = F.from_json("item", "map<string,string>")
    text = F.coalesce(F.get_json_object("item", "$.text"), F.get_json_object("item", "$.content"), F.col("item"))
    rest = F.map_filter(whole, lambda k, v: ~k.isin("text", "content") & v.isNotNull())
    return with_id(items.where(whole.isNotNull()).select("source", "row", text.alias("text"), rest.alias("metadata")))


def notebooks(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-empty cell; code cells are fenced."""
    schema = "struct<cells:array<struct<cell_type:string,source:string>>>"
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    cells = raw.select("source", F.posexplode(F.from_json("value", schema)["cells"]).alias("row", "cell"))
    lines = F.from_json(F.col("cell.source"), "array<string>")
    body = F.coalesce(F.array_join(lines, ""), F.col("cell.source"))
    fenced = F.concat(F.lit("```python\n"), body, F.lit("\n```"))
    text = F.when(F.col("cell.cell_type") == "code", fenced).otherwise(body)
    return with_id(cells.where(F.trim(body) != "").select("source", "row", text.alias("text")))


def sql_statements(spark: SparkSession, path: str) -> DataFrame:
    """One row per statement; statements end at ``;`` before a line end, pure comments go."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    parts = raw.select("source", F.posexplode(F.split("value", r";\s*(\n|$)")).alias("row", "text"))
    clean = parts.withColumn("text", F.trim("text")).where((F.col("text") != "") & ~F.col("text").startswith("--"))
    return with_id(clean)


def latex(spark: SparkSession, path: str) -> DataFrame:
    return text_files(spark, path, "*.tex").withColumn("text", strip_latex(F.col("text")))


#: White space of HTML. Where a reader takes ``white``, None stands for all that Unicode counts as such.
WHITE = " \t\n\r\f"


class _Visible(HTMLParser):
    def __init__(self, white: str | None = None):
        super().__init__()
        self.hidden, self.parts, self.white = 0, [], white

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip(self.white):
            self.parts.append(data.strip(self.white))


def visible_text(html: str, white: str | None = None) -> str:
    parser = _Visible(white)
    parser.feed(html)
    return " ".join(parser.parts)


#: Characters that XML may not hold, not even as references.
NOT_XML = "".join(map(chr, (*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF)))


def xml_root(data: bytes) -> ET.Element:
    """The root of an XML file. Characters that XML may not hold are kept, by private ones in their place."""
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        text = data.decode("utf-8", "replace")
        if not re.search(f"[{NOT_XML}]", text):
            raise
        free = (range(at, at + len(NOT_XML)) for at in range(0xF0000, 0xFFF00, len(NOT_XML)))
        places = next(r for r in free if not re.search(f"[{chr(r[0])}-{chr(r[-1])}]", text))
        root = ET.fromstring(text.translate(dict(zip(map(ord, NOT_XML), places, strict=True))))
        back = dict(zip(places, NOT_XML, strict=True))
        for node in root.iter():
            node.text, node.tail = (x and x.translate(back) for x in (node.text, node.tail))
            for key, value in node.attrib.items():
                node.attrib[key] = value.translate(back)
        return root


def xml_text(data: bytes, exact: bool = False) -> str:
    """``<tag attribute="value"> text`` lines; broken XML loses its tags. ``exact`` strips white space
    of ``WHITE`` only, and an element that holds nothing has an empty text."""
    try:
        root = xml_root(data)
    except ET.ParseError:
        return " ".join(re.sub(r"<[^>]*>", " ", data.decode("utf-8", "replace")).split())
    lines = []
    for node in root.iter():
        attributes = "".join(f' {k}="{v}"' for k, v in node.attrib.items())
        text = (node.text or "").strip(WHITE if exact else None)
        lines.append(f"<{node.tag}{attributes}> {text}" if text or (exact and not len(node)) else f"<{node.tag}{attributes}>")
    return "\n".join(lines)


def mail_text(data: bytes, white: str | None = None) -> str:
    message = email.message_from_bytes(data, policy=email.policy.default)
    heads = [f"{h}: {message[h]}" for h in ("From", "To", "Date", "Subject") if message[h]]
    body = message.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = visible_text(text, white)
    return "\n".join([*heads, "", text.strip(white)])


#: What an RTF file is made of: a byte, a UTF-16 unit, a control word, a control sign, a brace, text.
RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?|\\([a-zA-Z]+)(?:-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", re.S)
#: Groups that hold no text, and control words that are characters. Fixed values of the format.
RTF_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"}
RTF_WORDS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•",
             "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(data: bytes, white: str | None = None) -> str:
    """The text of an RTF file, trimmed. A UTF-16 unit takes the place of the one character after it."""
    out: list[str] = []
    groups, silent, stand_in = [], False, False
    for byte, unit, word, sign, brace, text in RTF.findall(data.decode("latin-1")):
        if brace == "{":
            groups.append(silent)
        elif brace:
            silent = groups.pop() if groups else False
        elif sign == "*" or word in RTF_SILENT:
            silent = True
        elif silent:
            continue
        elif unit:
            out.append(chr(int(unit) % 65536))
        else:
            said = bytes.fromhex(byte).decode("cp1252", "replace") if byte else text
            if stand_in:
                said = said[1:]
            elif sign:
                said = {"~": "\xa0", "_": "-", "-": ""}.get(sign, sign if sign in "\\{}" else "")
            elif word:
                said = RTF_WORDS.get(word, "")
            out.append(said)
        stand_in = bool(unit)
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip(white)


def zipped_xml_text(part: str, unit: str, exact: bool = False) -> Callable[[bytes], str]:
    """Text of a zipped office file's parts: runs of a paragraph joined, paragraphs by a blank line; blank
    paragraphs are left out but for ``exact``."""
    import zipfile

    def read(data: bytes) -> str:
        out = []
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for name in sorted(archive.namelist()):
                if re.fullmatch(part, name):
                    for p in xml_root(archive.read(name)).iter():
                        if p.tag.endswith(unit):
                            text = "".join(t.text or "" for t in p.iter() if t.tag.endswith("}t"))
                            if exact or text.strip():
                                out.append(text)
        return "\n\n".join(out)

    return read


def sheet_column(reference: str) -> int:
    """Column number from 0 of a cell such as ``AB7``."""
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter) - 64
    return number - 1


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str], list[str]]]:
    """(sheet, row, header, cells) of every row below the first of each sheet of an .xlsx file.

    Formulas give their stored values; empty cells are empty strings, unnamed columns are
    ``Unnamed: i`` and a repeated name has ``.k`` added. A sheet without rows below its header
    gives none, and dates are their serial numbers.
    """
    import posixpath
    import zipfile

    def parts(node: ET.Element, name: str) -> list[ET.Element]:
        return [e for e in node.iter() if e.tag.endswith("}" + name)]

    def words(node: ET.Element) -> str:
        return "".join(t.text or "" for t in parts(node, "t"))

    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        shared = "xl/sharedStrings.xml"
        strings = [words(e) for e in parts(xml_root(archive.read(shared)), "si")] if shared in names else []
        links = ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        targets = {e.attrib["Id"]: posixpath.join("/xl", e.attrib["Target"])[1:] for e in links}
        for sheet in parts(ET.fromstring(archive.read("xl/workbook.xml")), "sheet"):
            key = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            header: list[str] | None = None
            for at, row in enumerate(parts(xml_root(archive.read(targets[key])), "row")):
                cells: list[str] = []
                for place, cell in enumerate(parts(row, "c")):
                    column = sheet_column(cell.attrib["r"]) if "r" in cell.attrib else place
                    value = next((v.text or "" for v in parts(cell, "v")), "")
                    kind = cell.attrib.get("t")
                    if kind == "s" and value:
                        value = strings[int(value)]
                    elif kind == "inlineStr":
                        value = words(cell)
                    elif kind == "b":
                        value = "True" if value == "1" else "False"
                    cells += [""] * (column + 1 - len(cells))
                    cells[column] = value
                if header is None:
                    seen: dict[str, int] = {}
                    header = []
                    for i, name in enumerate(c or f"Unnamed: {i}" for i, c in enumerate(cells)):
                        header.append(f"{name}.{seen[name]}" if name in seen else name)
                        seen[name] = seen.get(name, 0) + 1
                    continue
                header += [f"Unnamed: {i}" for i in range(len(header), len(cells))]
                yield sheet.attrib["name"], at - 1, list(header), cells + [""] * (len(header) - len(cells))


def row_line(title: str, header: list[str], cells: list[str], exact: bool = False) -> str:
    """A row of a table as text, as ``table_row_text`` gives it; with empty cells if ``exact``."""
    named = " | ".join(f"{h}: {c}" for h, c in zip(header, cells, strict=True) if exact or c.strip())
    return f"Context: {title} | Columns: [{', '.join(header)}] | Data: {named}"


#: The largest file that is read whole.
MOST_BYTES = 100 * 1024 * 1024


def workbooks(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, text, source, sheet, row, error): one row per row of each sheet of the .xlsx files
    under ``path``. A file that cannot be read or has over ``most_bytes`` is one row with its error;
    others go on."""
    schema = "source string, sheet string, row long, text string, error string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, data in zip(batch["path"], batch["content"], strict=True):
                title, found = basename_of(source), []
                try:
                    for sheet, row, header, cells in workbook_rows(data):
                        found.append((source, sheet, row, row_line(f"{title}[{sheet}]", header, cells), None))
                except Exception as problem:  # one file's fault is not the others'
                    found = [(source, None, None, None, f"{type(problem).__name__}: {problem}")]
                yield pd.DataFrame(found, columns=["source", "sheet", "row", "text", "error"], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").endswith(".xlsx"))
    rows = files.where(F.col("length") <= most_bytes).select("path", "content").mapInPandas(read, schema)
    over = files.where(F.col("length") > most_bytes).select(
        F.col("path").alias("source"), *[F.lit(None).cast(t).alias(c) for c, t in (("sheet", "string"), ("row", "long"), ("text", "string"))],
        F.lit("file too large").alias("error"),
    )
    rows = rows.unionByName(over)
    key = F.concat_ws("#", "source", "sheet", F.col("row").cast("string"))
    return rows.withColumn("id", F.concat(F.lit("excel_"), F.sha2(key, 256)))


def workbook_text(data: bytes) -> str:
    return "\n".join(row_line(sheet, header, cells) for sheet, _, header, cells in workbook_rows(data))


def epub_chapters(data: bytes, white: str | None = None) -> Iterator[tuple[str, str | None]]:
    """(name, text) of a book's pages in order of their names; null for a page of no bytes."""
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for name in sorted(n for n in archive.namelist() if n.endswith((".xhtml", ".html", ".htm"))):
            page = archive.read(name).decode("utf-8", "replace")
            yield name, visible_text(page, white) if page else None


def epub_text(data: bytes) -> str:
    return "\n\n".join(text or "" for _, text in epub_chapters(data))


#: Extension to a parser of a file's bytes. More can be added: PDF and images need libraries or
#: models that the caller brings.
PARSERS: dict[str, Callable[[bytes], str]] = {
    "html": lambda data: visible_text(data.decode("utf-8", "replace")),
    "htm": lambda data: visible_text(data.decode("utf-8", "replace")),
    "xml": xml_text,
    "eml": mail_text,
    "rtf": rtf_text,
    "docx": zipped_xml_text(r"word/document\.xml", "}p"),
    "pptx": zipped_xml_text(r"ppt/slides/slide\d+\.xml", "}p"),
    "xlsx": workbook_text,
    "epub": epub_text,
    "txt": lambda data: data.decode("utf-8", "replace"),
    "md": lambda data: data.decode("utf-8", "replace"),
}
PARSERS |= {e: PARSERS["txt"] for e in CODE_EXTENSIONS}


def directory(
    spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], str]] | None = None
) -> DataFrame:
    """(id, text, source, error) of every file under ``path`` whose extension has a parser.

    A file that fails or is over 100 MB has a null text and its error; others go on.
    """
    known = PARSERS | (parsers or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for source, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts.append(known[source.rsplit(".", 1)[-1].lower()](data))
                    errors.append(None)
                except Exception as problem:  # one file's fault is not the others'
                    texts.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pd.DataFrame({"source": batch["path"], "text": texts, "error": errors})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    fit = files.where(extension.isin(*known) & (F.col("length") <= MOST_BYTES))
    large = files.where(extension.isin(*known) & (F.col("length") > MOST_BYTES))
    rows = fit.select("path", "content").mapInPandas(read, "source string, text string, error string")
    over = large.select(
        F.col("path").alias("source"), F.lit(None).cast("string").alias("text"), F.lit("file too large").alias("error")
    )
    return with_id(rows.unionByName(over))


def parse_json_output(text: str) -> object:
    """A model's JSON answer, with or without code fences."""
    return json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip()))
