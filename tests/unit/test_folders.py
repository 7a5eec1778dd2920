"""Folders of files: no file vanishes, whatever it holds."""

import json

import pytest
from pyspark.sql import functions as F

from skein.plans.files import rtf
from skein.sources import folders, readers


def texts_of(rows, name):
    return [r.text for r in sorted((r for r in rows if r.source.endswith("/" + name)), key=lambda r: (r.row is None, r.row or 0))]


def test_every_known_file_gives_a_row(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text("Hello\n")
    (tmp_path / "blank.csv").write_text("\n")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list.json").write_text(json.dumps([{"text": "x", "n": 1, "z": None}, "no object", {"k": [1]}]))
    (tmp_path / "t.csv").write_text("name,age\nAnn,31 \n\nBob,45\nCid,40,9\n")
    (tmp_path / "p.py").write_text("a = 1\n")
    (tmp_path / "large.md").write_text("y" * 500)
    (tmp_path / "skip.bin").write_bytes(b"x")
    (tmp_path / "own.log").write_text("k")
    spark.range(2).write.parquet(str(tmp_path / "sub/t"))
    own = {"log": ("log", lambda data, title: iter([(title, {"size": str(len(data))})]))}
    rows = folders.folder_documents(spark, str(tmp_path), parsers=own, most_bytes=490).where("NOT (kind = 'parquet')").collect()
    assert texts_of(rows, "sub/a.md") == ["[File Path: sub/a.md]\nHello\n"]
    errors = {r.source.rsplit("/", 1)[-1]: r.error for r in rows if r.error}
    assert errors["blank.csv"] == "no records" and errors["large.md"] == "file too large" and "JSONDecodeError" in errors["bad.json"]
    assert set(errors) == {"blank.csv", "large.md", "bad.json"}
    assert texts_of(rows, "p.py") == ["a = 1\n"]
    assert [t.split("Data: ")[1] for t in texts_of(rows, "t.csv")] == ["name: Ann | age: 31", "name: Bob | age: 45", "name: Cid | age: 40 | Extra_Col_2: 9"]
    assert [(r.text.split("\n")[1], r.metadata) for r in rows if r.kind == "json" and r.row is not None] == [("x", {"n": "1"}), ('{"k": [1]}', {"k": "[1]"})]
    assert [r.metadata for r in rows if r.kind == "log"] == [{"size": "1"}]
    assert len({r.id for r in rows}) == len(rows)


def test_rows_of_stored_tables_and_odd_file_rows(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = folders.folder_documents(spark, str(tmp_path)).where("kind = 'parquet'").orderBy("row").collect()
    assert [r.text.split("Data: ")[1] for r in rows] == ["id: 0", "id: 1", "id: 2"]
    made = spark.createDataFrame([(None, b"x"), ("a.md", None), ("b.md", b"t"), ("b.md", b"t")], "path string, content binary")
    odd = folders.parse_files(made.withColumn("source", F.lit(1)).withColumn("text", F.lit(2)))
    assert sorted((r.source, r.text, r.error) for r in odd.collect() if r.text) == [("b.md", "[File Path: b.md]\nt", None)] * 2
    assert [r.error for r in odd.where("source = 'a.md'").collect()] == ["no records"]
    assert folders.parse_files(made.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, tabular",
    [("a\tb\tc\n1\t2\t3", True), ("a,b,c,d\n1,2,3,4", True), ("one, two, three", False), ("Some words,\nand more.", False), ("", False)],
)
def test_texts_that_are_tables(text, tabular):
    assert folders.looks_tabular(text) == tabular
    found = [t for t, _ in folders.smart_records(text.encode(), "f.txt")]
    assert all(t.startswith("Context: f.txt") for t in found) if tabular else found == [text] * bool(text)


@pytest.mark.parametrize("text", ["plain", "a {b} \\c", "zwölf Ελλάδα 日本", "line\nline", "\U0001f600 up", ""])
def test_rtf_gives_back_what_was_written(text):
    assert readers.rtf_text(rtf(text)) == text


def test_rtf_groups_and_signs():
    unit = b"\\" + b"u8212?"
    data = rb"{\rtf1{\*\generator X;}{\info{\title T}}A\~b \'e9\par\b bold\b0\emdash c" + unit + rb"\'80 d}"
    assert readers.rtf_text(data) == "A\xa0b é\nbold—c—€ d"


def test_headers_are_told_by_the_columns_that_rows_have():
    told = lambda text: [r[0].split("Columns: ")[1] for r in folders.table_records(text, "t")]
    # an 'e' or '1' in each line is no delimiter; a name as long as the words below it is still a name
    for lang in ("en", "none"):
        for n in (8, 1020, 1344):
            found = told(f"key,lang\n{n},{lang}\n{n + 1},{lang}\n{n + 2},{lang},more\n")
            assert found[0] == f"[key, lang, Extra_Col_2] | Data: key: {n} | lang: {lang}" and len(found) == 3
    assert told("1,2\n3,4\n") == ["[Col_0, Col_1] | Data: Col_0: 1 | Col_1: 2", "[Col_0, Col_1] | Data: Col_0: 3 | Col_1: 4"]
    assert told("a,b\n") == ["[Col_0, Col_1] | Data: Col_0: a | Col_1: b"]
