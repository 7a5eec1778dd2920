import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.llm.fill_middle import fill_middle, restore
from skein.llm.queries import op11_fill_middle
from tests.conftest import SMALL

MARKS = ("<P>", "<S>", "<M>")
ODD = [
    "", "a", None, "\x01", "\x02", "\x020\x01a\x021", "\x02\x02\x01\x010", "<P>x", "a<M>b", "<<S", "\U0001d4b3y z\U0001d4b3",
    "aa\n\nbb\r\n", "1" * 50, "é" * 40 + "x" * 40, "$0 \\1 $1", "word " * 20_000,
]


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if text == "" or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    found = fill_middle(frame).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        got = r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output
        assert got == expected(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_odd_texts_at_many_ids(spark):
    check(spark, [(None, "no id here"), (7, "again"), (7, "again")] + [(100 * i + k, t) for i, t in enumerate(ODD) for k in range(12)])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ09 \x01\x02<P>SM\né\U0001f600", max_size=40), min_size=1, max_size=60))
def test_any_text_comes_back(spark, texts):
    check(spark, list(enumerate(texts)))


def test_query_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in docs}
    found = op11_fill_middle(spark, SMALL).collect()
    assert len(found) == len(docs)
    for r in found:
        n, form, p, m, output = expected(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle(empty).collect() == []
    clash = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, form string, _fim_text string")
    row = fill_middle(clash).first()
    assert row.form == expected(1, "a b")[1] and row._fim_text == "y" and row.output == expected(1, "a b")[4]


@pytest.mark.parametrize("kind", ["psm", "spm"])
def test_other_markers_and_rates(spark, kind):
    frame = spark.createDataFrame([(i, f"text {i} <P> here") for i in range(50)], "doc_id long, text string")
    from pyspark.sql import functions as F

    marks = ("<pre>", "<suf>", "<mid>")
    found = fill_middle(frame, rate=100, suffix_first=100 if kind == "spm" else 0, markers=marks)
    rows = found.withColumn("back", restore(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in rows} == {kind} and all(r.back == r.text for r in rows)
