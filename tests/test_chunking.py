import pytest

from passagemill.operators.chunking import (
    OUTLINES,
    chunk_by_lines,
    chunk_by_structure,
    chunk_files,
    chunking_stats,
    split_large_chunks,
)

FILE = "filepath string, content string, language string"


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("filepath", "start_line", "end_line").select(*columns).collect()]


def test_windows_match_a_plain_loop(spark):
    text = "\n".join(f"line {i}" if i % 7 else "" for i in range(1, 57)) + "\n"
    files = spark.createDataFrame([("a", text, "en"), ("b", "\n \n", "en"), ("c", "one", "en"), ("d", "", "en")], FILE)
    for size, overlap in [(10, 3), (500, 50), (1, 0), (56, 55)]:
        want = []
        for name, content, _ in files.collect():
            lines = content.split("\n")
            for i in range(0, len(lines), size - overlap):
                part = lines[i : i + size]
                if "\n".join(part).strip():
                    want.append((f"{name}:{i + 1}-{i + len(part)}", "\n".join(part)))
        got = chunk_by_lines(files, size, overlap).select("id", "content").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunk_by_lines(spark.createDataFrame([], FILE), 10, 10)


def test_split_parts_match_a_plain_loop(spark):
    schema = "filepath string, content string, start_line int, end_line int, language string, symbol_type string, symbol_name string"
    chunks = [(f"f{n}", "\n".join(str(i) for i in range(n)), 5, 4 + n, "en", "class", "C") for n in range(1, 40)]
    for biggest, smallest in [(10, 3), (7, 7), (2, 3), (1, 1)]:
        want = []
        for name, content, start, _, _, _, _ in chunks:
            lines = content.split("\n")
            n = len(lines)
            if n <= biggest:
                want.append((name, content, start, start + n - 1, "C"))
                continue
            parts = -(-n // biggest)
            per = -(-n // parts)
            out = []
            for i in range(parts):
                a, b = i * per, min((i + 1) * per, n)
                if b - a < smallest and out:
                    out[-1] = (name, out[-1][1] + "\n" + "\n".join(lines[a:b]), out[-1][2], start + b - 1, out[-1][4])
                else:
                    out.append((name, "\n".join(lines[a:b]), start + a, start + b - 1, f"C (part {i + 1})"))
            want += out
        got = split_large_chunks(spark.createDataFrame(chunks, schema), biggest, smallest)
        assert sorted(rows(got, "filepath", "content", "start_line", "end_line", "symbol_name")) == sorted(want)


PYTHON = '''import os
from sys import path

def hello():
    return 1

# says goodbye
def goodbye():
    return 2

class Person:
    def name(self):
        return "x"
'''


def test_python_structure(spark):
    files = spark.createDataFrame([("p.py", PYTHON, "python")], FILE)
    got = rows(chunk_by_structure(files, OUTLINES["python"]), "symbol_type", "symbol_name", "start_line")
    assert got == [("import", "imports", 1), ("function", "hello", 4), ("function", "goodbye", 7), ("class", "Person", 11)]


def test_big_class_is_cut_into_members(spark):
    text = "class Big {\n" + "\n".join(f"  method{i}() {{ return {i}; }}" for i in range(200)) + "\n}"
    files = spark.createDataFrame([("b.ts", text, "typescript")], FILE)
    got = rows(chunk_by_structure(files, OUTLINES["typescript"]), "symbol_type", "symbol_name", "content")
    assert got[0][:2] == ("class", "Big (header)")
    assert [g[1] for g in got[1:4]] == ["Big.method0", "Big.method1", "Big.method2"]
    assert "\n".join(g[2] for g in got) == text


@pytest.mark.parametrize("language", sorted(OUTLINES))
def test_structure_covers_every_line_once(spark, language):
    text = "\n".join(
        ["// lead", "func a() {", "}", "class B {", "  def m(x)", "  }", "public class D {", "}", "fn z() {}", "type T interface {", "}", "tail"] * 30
    )
    files = spark.createDataFrame([("x", text, language)], FILE)
    got = rows(chunk_by_structure(files, OUTLINES[language], 8, 2), "start_line", "end_line", "content", "symbol_type")
    plain = [g for g in got if g[3] != "import"]
    assert "\n".join(g[2] for g in plain) == text
    assert all(b[0] == a[1] + 1 for a, b in zip(plain, plain[1:]))


def test_routing_and_stats(spark):
    files = spark.createDataFrame(
        [("a.py", PYTHON, "python"), ("b.py", "x = 1\n", "python"), ("c.md", "# t\ntext", "markdown")], FILE
    )
    chunks = chunk_files(files)
    per_file = chunks.select("filepath", "method", "fell_back").distinct()
    assert sorted(map(tuple, per_file.collect())) == [
        ("a.py", "structure", False), ("b.py", "lines", True), ("c.md", "lines", False)
    ]
    stats = chunking_stats(per_file).first().asDict()
    assert (stats["structure_chunked"], stats["line_chunked"], stats["fallbacks"]) == (1, 2, 1)
    assert stats["fallback_percent"] == 33.3 and stats["fallback_names"] == "b.py"


def test_module_extensions_are_cut_by_structure(spark):
    rows = [("a.pyi", "pyi", "def one():\n    pass\n"), ("b.mjs", "mjs", "export function two() {\n}\n"), ("c.kt", "kotlin", "fun x() {}\n")]
    files = spark.createDataFrame(rows, "filepath string, language string, content string")
    method = {r["filepath"]: r["method"] for r in chunk_files(files).collect()}
    assert method == {"a.pyi": "structure", "b.mjs": "structure", "c.kt": "lines"}
