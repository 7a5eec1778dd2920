"""Running totals in groups that are spread over ranges, against a plain loop."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.operators import graph, ingest, windows
from skein.operators.running import in_ranges, running
from skein.sources import readers


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Ranges stay as small as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_group_lies_in_several_ranges(spark):
    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 40}", i, rng.choice([None, -2, 0, 5])) for i in range(3000)]
    rng.shuffle(rows)
    ranged = in_ranges(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], ["o"])
    assert ranged.where("k = 'hot'").select("_range").distinct().count() > 1
    total = running(ranged, ["k"], ["o"], "total", F.col("v"))
    both = running(total, ["k"], ["o"], "most", F.col("v"), "max")
    sums, most = {}, {}
    expected = []
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        if v is not None:
            sums[k] = sums.get(k, 0) + v
            most[k] = max(most.get(k, v), v)
        expected.append((k, o, sums.get(k), most.get(k)))
    got = [tuple(r) for r in both.select("k", "o", "total", "most").orderBy("o").collect()]
    assert got == expected
    assert running(ranged.limit(0), ["k"], ["o"], "total", F.col("v")).count() == 0


def test_blocks_of_a_hot_source(spark):
    rng = random.Random(4)
    rows = [("s" if i % 3 else None, i, rng.choice([True, False, False, False, None]), "t") for i in range(2000)]
    got = windows.structure_blocks(spark.createDataFrame(rows, "source string, chunk_index int, is_heading boolean, block string"), 5)
    found = {(r.source, r.chunk_index): (r.section, r.block) for r in got.collect()}
    state = {}
    for source, at, heading, _ in rows:
        section, place = state.get(source, (0, 0))
        if heading:
            section, place = section + 1, 0
        assert found[source, at] == (section, place // 5)
        state[source] = (section, place + 1)
    assert len(found) == len(rows)


def test_chunks_of_equal_order_share_a_place(spark):
    rows = [("s", 1, False), ("s", 1, True), ("s", 1, True), ("s", 2, False)]
    got = windows.structure_blocks(spark.createDataFrame(rows, "source string, chunk_index int, is_heading boolean"), 1)
    assert sorted((r.chunk_index, r.section, r.block) for r in got.collect()) == [(1, 1, 0)] * 3 + [(2, 1, 1)]


def test_budget_of_a_hot_query(spark):
    rows = [(1 if i < 1500 else i, i, i % 4) for i in range(2000)]
    frame = spark.createDataFrame(rows, "query_id int, rank int, cost int")
    got = {(r.query_id, r.rank) for r in graph.prefix_budget(frame, 700, F.col("cost")).collect()}
    spent, expected = {}, set()
    for query, rank, cost in rows:
        spent[query] = spent.get(query, 0) + cost
        if spent[query] <= 700:
            expected.add((query, rank))
    assert got == expected


def test_project_tree_ends_on_a_cycle(spark):
    frame = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", "y")], "project string, parent string")
    assert {r.project for r in ingest.project_tree(frame, "a").collect()} == {"b", "c"}


def test_workbooks(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {link}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        )
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>An</t></r><r><t>n</t></r></si></sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c></row>'
            '<row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7.5</v></c></row>'
            '<row><c r="B3" t="inlineStr"><is><t>mid</t></is></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>',
        )
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    rows = readers.workbooks(spark, str(tmp_path)).orderBy("source", "row").collect()
    assert [(r.sheet, r.row, r.text) for r in rows if r.error is None] == [
        ("One", 0, "Context: b.xlsx[One] | Columns: [name, Unnamed: 1, name.1] | Data: name: Ann | name.1: 7.5"),
        ("One", 1, "Context: b.xlsx[One] | Columns: [name, Unnamed: 1, name.1] | Data: Unnamed: 1: mid | name.1: True"),
    ]
    assert ["BadZipFile" in r.error for r in rows if r.error] == [True]
    large = readers.workbooks(spark, str(tmp_path), most_bytes=1).collect()
    assert [(r.error, r.text) for r in large] == [("file too large", None)] * 2
    assert readers.directory(spark, str(tmp_path)).where("error IS NULL").count() == 1
