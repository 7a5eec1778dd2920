"""Files of odd documents, each of every kind: the records are the SQL's."""

import duckdb

from skein.plans.files import FILES, KINDS, read_files
from skein.sources import folders, readers

ODD = [
    None, "", " ", "\n", "\t", "\xa0", "plain", "  a b ", "\n\na\n", "\xa0a\xa0", "\x0ba\x0b", "\x1ca\x1d", "\x85a\x85", "　a　", "​a﻿",
    "a\rb", "a\r\nb", "a\r", "a\x00b", "a\x01b", "a\x0cb", "a\x0bb", "a\x7fb", "a\x80b\x9f", "a￾b￿", "\U000f0000\x02", "a b c", "\U0001f600 up",
    "a <b> & c </p> &amp; &lt; &#65; &#x41 &copy", "]]> <![CDATA[x]]> <!-- c -->", "<script>x</script>", "a {b} \\c \\u233? \\'e9 \\par x \\*", "\"a\" 'b' ,",
    '{"a": 1}\n[1]', "From: x\n\nSubject: y\n--b\nFrom me", "w " * 40000 + "e", "x" * 140000, "a,b,c\n1,2,3", "a\n\n\nb", "a | b |", "a;\nb;", "é1é 2é", "=?utf-8?q?x?= =20",
]


def test_records_of_odd_documents_are_those_of_the_sql(spark, tmp_path):
    texts = [(text, ("en", None, "de")[at % 3]) for at, text in enumerate(ODD) for _ in KINDS]
    rows = [(number, text, lang) for number, (text, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.sql(FILES).fetchall()
    got = [tuple(r) for r in read_files(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0], -1 if r[1] is None else r[1])
    differ = [pair for pair in zip(sorted(got, key=key), sorted(want, key=key), strict=True) if pair[0] != pair[1]]
    assert not differ, differ[:3]


def test_exact_reading_loses_no_text(spark):
    files = [("a.md", None), ("b.md", b""), ("c.html", "<p>\xa0</p>".encode()), ("d.xml", b"<a><b/></a>"), ("e.txt", b"")]
    made = spark.createDataFrame(files, "path string, content binary")
    exact = {r.source: (r.row, r.text, r.error) for r in folders.parse_files(made, exact=True).collect()}
    assert exact == {
        "a.md": (0, None, None), "b.md": (0, "[File Path: b.md]\n", None), "c.html": (0, "[File Path: c.html]\n\xa0", None),
        "d.xml": (0, "[File Path: d.xml]\n<a>\n<b> ", None), "e.txt": (0, "[File Path: e.txt]\n", None),
    }
    assert {r.source: r.error for r in folders.parse_files(made).collect()} == {"a.md": "no records", "b.md": "no records", "c.html": "no records", "d.xml": None, "e.txt": "no records"}


def test_xml_keeps_the_characters_that_it_may_not_hold():
    assert readers.xml_text(b'<a k="\x02"><b>x\x01y\x0b</b>\x03</a>') == '<a k="\x02">\n<b> x\x01y'
    assert readers.xml_text("<a><b>\U000f0000\x01￾\U000f0001</b></a>".encode()) == "<a>\n<b> \U000f0000\x01￾\U000f0001"
    assert readers.xml_text(b"<a>x\x01") == "x\x01"
