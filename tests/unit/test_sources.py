"""Readers and streaming over small files."""

import json
import zipfile

from pyspark.sql import functions as F

from skein.sources import readers
from skein.streaming import ingest
from tests.conftest import rows_of


def test_directory_reads_kinds_and_reports_faults(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("<p>Hi <b>there</b><script>x</script></p>")
    (tmp_path / "sub/b.xml").write_text('<r><i k="v">text</i></r>')
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.eml").write_text("From: a@b.c\nSubject: S\n\nBody here\n")
    (tmp_path / "e.rtf").write_text(r"{\rtf1\ansi Some \b bold\b0  text\par}")
    (tmp_path / "skip.bin").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>One</w:t><w:t> two</w:t></w:p></w:d>')
    got = {r.source.rsplit("/", 1)[-1]: r for r in readers.directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.html", "b.xml", "c.docx", "d.eml", "e.rtf", "f.docx"}
    assert got["a.html"].text == "Hi there"
    assert '<i k="v"> text' in got["b.xml"].text
    assert got["c.docx"].text is None and "BadZipFile" in got["c.docx"].error
    assert got["d.eml"].text.endswith("Body here")
    assert got["e.rtf"].text.startswith("Some bold")
    assert got["f.docx"].text == "One two"


def test_tables_and_json(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,the city\nAnn,Oslo\nBob,\n")
    texts = sorted(r.text for r in readers.delimited(spark, str(tmp_path / "t.csv")).collect())
    assert texts[0].endswith("Data: name: Ann | the city: Oslo") and texts[1].endswith("Data: name: Bob")
    (tmp_path / "l.json").write_text(json.dumps([{"text": "one", "k": 1}, {"content": "two"}]))
    assert sorted(r.text for r in readers.json_documents(spark, str(tmp_path / "l.json")).collect()) == ["one", "two"]
    (tmp_path / "l.jsonl").write_text('{"text": "x"}\n\nbroken\n{"a": 1}\n')
    got = sorted(r.text for r in readers.json_documents(spark, str(tmp_path / "l.jsonl"), lines=True).collect())
    assert got == ["x", '{"a": 1}'] or got == ['{"a": 1}', "x"]


def test_notebook_and_sql(spark, tmp_path):
    cells = [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": ["1+1"]}]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": cells}))
    got = [r.text for r in readers.notebooks(spark, str(tmp_path / "n.ipynb")).orderBy("row").collect()]
    assert got == ["# T\nx", "```python\n1+1\n```"]
    (tmp_path / "s.sql").write_text("SELECT 1;\n-- note;\nSELECT 2;\n")
    assert [r.text for r in readers.sql_statements(spark, str(tmp_path / "s.sql")).collect()] == ["SELECT 1", "SELECT 2"]


def test_stream_ingest_equals_batch(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    for part in ([(1, "a"), (2, "a")], [(3, "a"), (4, "b")]):
        spark.createDataFrame(part, "id int, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id int, text string").parquet(str(source))
        ingest.ingest_stream(stream, store, str(tmp_path / "check")).awaitTermination()
    assert rows_of(ingest.stored(spark, store).select("id")) == [(1,), (2,), (4,)]
    ingest.compact(spark, store, str(tmp_path / "compact"))
    assert ingest.stored(spark, str(tmp_path / "compact")).count() == 3


def test_stream_of_facts_closes_scopes(spark, tmp_path):
    rows = [("s", 1, "2024-01-01"), ("s", 2, "2024-01-02"), ("t", 3, "2024-01-01")]
    df = spark.createDataFrame(rows, "scope_key string, fact_id long, at string")
    df.withColumn("valid_at", F.col("at").cast("timestamp")).drop("at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scope_key string, fact_id long, valid_at timestamp").parquet(str(tmp_path / "in"))
    query = (
        ingest.upsert_facts(stream)
        .writeStream.format("memory")
        .queryName("closed")
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows_of(spark.table("closed").select("fact_id", "status")) == [(1, "superseded")]
