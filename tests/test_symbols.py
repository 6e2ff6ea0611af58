import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.functions.kinds import kind_number
from passagemill.operators import edits, grep, issues, notes
from passagemill.operators import symbols as ops

FILE = "filepath string, content string, language string"
PYTHON = "import os\n\ndef top(a):\n    return helper(a)\n\nclass Person:\n    def name(self):\n        return top(1)\n\n    def age(self):\n        return 1\n"
OTHER = "from p import top\nx = top(top(2)) + stop\n# top\n"


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("p.py", PYTHON, "python"), ("lib/q.py", OTHER, "python")], FILE)


def test_extract_symbols(files):
    got = ops.extract_symbols(files).orderBy("start_line").select("name_path", "kind", "depth", "start_line", "end_line", "start_column", "kind_path")
    assert [tuple(r) for r in got.collect()] == [
        ("/top", 12, 0, 3, 5, 4, [12]),
        ("/Person", 5, 0, 6, 12, 6, [5]),
        ("/Person/name", 6, 1, 7, 9, 8, [5, 6]),
        ("/Person/age", 6, 1, 10, 12, 8, [5, 6]),
    ]


def test_find_symbol_and_pruning(files):
    table = ops.extract_symbols(files)
    names = lambda df: sorted(r["name_path"] for r in df.collect())
    assert names(ops.find_symbol(table, "Person/na*")) == ["/Person/name"]
    assert names(ops.find_symbol(table, "name", depth=0)) == []
    assert names(ops.find_symbol(table, "", not_kinds=[kind_number("class")])) == ["/top"]
    assert names(ops.find_symbol(table, "", kinds=[5, 6], not_kinds=[5])) == []
    assert names(ops.find_symbol(table, "top", path="lib")) == []
    assert ops.with_body(ops.find_symbol(table, "age"), files).first()["body"].startswith("    def age(self):")
    assert ops.first_symbol(table, "*").first()["name_path"] == "/top"
    overview = {r["name"]: (r["kind_name"], r["lines"], r["children"]) for r in ops.symbols_overview(table).collect()}
    assert overview == {"top": ("Function", "3-5", 0), "Person": ("Class", "6-12", 2)}
    assert names(ops.children_of(table, "/Person")) == ["/Person/age", "/Person/name"]


def test_references_small_and_large_name_sets(files):
    definitions = ops.extract_symbols(files).filter("name_path = '/top'")
    refs = ops.find_references(files, definitions)
    got = sorted((r["filepath"], r["line"], r["column"]) for r in refs.collect())
    assert got == [("lib/q.py", 1, 14), ("lib/q.py", 2, 4), ("lib/q.py", 2, 8), ("lib/q.py", 3, 2), ("p.py", 8, 15)]
    snippet = refs.filter("filepath = 'p.py'").first()["snippet"]
    assert snippet == "    def name(self):\n        return top(1)\n"
    joined = ops.find_occurrences(files, definitions, broadcast_names=0)
    direct = ops.find_occurrences(files, definitions)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, direct.collect()))
    assert ops.find_references(files, definitions, kinds=[5]).count() == 0
    assert ops.find_references(files, definitions, kinds=[13]).count() == 5
    whole = ops.drop_definitions(direct, definitions.withColumn("end_line", F.lit(8)), whole_range=True)
    assert whole.filter("filepath = 'p.py'").count() == 0
    by_file = {r["filepath"]: r["n"] for r in ops.references_by_file(refs).collect()}
    assert by_file == {"lib/q.py": 4, "p.py": 1}


PATTERNS = [r"top", r"^\s*def (\w+)", r"\)\n", r"x*", r"return.*\n\n", r"[a-z]+\(", r"(?s)class.*?age"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_grep_equals_a_plain_loop(files, pattern):
    want = []
    for name, text, _ in files.collect():
        lines = text.split("\n")
        for m in re.compile(pattern, re.M | re.A).finditer(text):
            before = text[: m.start()]
            line = before.count("\n") + 1
            context = "\n".join(lines[max(0, line - 2) : line + 2])
            want.append((name, line, m.start() - (before.rfind("\n") + 1), len(m.group()), context))
    got = grep.grep(files, pattern, before=1, after=2)
    got = [tuple(r) for r in got.select("filepath", "line", "match_start", "match_length", "content").collect()]
    want = [w[:4] + ("\n".join(dict(zip(["p.py", "lib/q.py"], [PYTHON, OTHER]))[w[0]].split("\n")[max(0, w[1] - 2) : w[1] + 2]),) for w in want]
    assert sorted(got) == sorted(want)


def test_grep_files_and_errors(files):
    assert {r["filepath"] for r in grep.grep(files, "top", include="lib/**").collect()} == {"lib/q.py"}
    assert {r["filepath"] for r in grep.grep(files, "top", include="lib/**", code_only=True).collect()} == {"lib/q.py", "p.py"}
    assert grep.grep(files, "top", exclude="**").count() == 0
    with pytest.raises(ValueError, match="Invalid regex"):
        grep.grep(files, "(")


def test_budget_equals_a_plain_loop(spark):
    rows = [(f"f{i % 5}", i, 0, 3, "c" * (i * 13 % 90)) for i in range(400)]
    matches = spark.createDataFrame(rows, "filepath string, line int, match_start int, match_length int, content string")
    for limit in (1, 50, 51, 999, 20_000, 10**6):
        used, want = 0, []
        for r in sorted(rows, key=lambda r: (r[0], r[1])):
            if used >= limit:
                break
            want.append(r[:2])
            used += len(r[4]) + 50
        got = grep.within_budget(matches, limit).select("filepath", "line").collect()
        assert sorted(map(tuple, got)) == sorted(want)


# ------------------------------------------------------------------ edits


def test_rename(files):
    definitions = ops.extract_symbols(files).filter("name_path = '/top'")
    targets = edits.rename_targets(ops.find_references(files, definitions), definitions)
    dry = {r["filepath"]: r["replacements"] for r in edits.rename(files, targets, "top", "peak", dry_run=True).collect()}
    assert dry == {"p.py": 2, "lib/q.py": 4}
    done = {r["filepath"]: (r["replacements"], r["content"]) for r in edits.rename(files, targets, "top", "peak").collect()}
    assert done["lib/q.py"] == (4, "from p import peak\nx = peak(peak(2)) + stop\n# peak\n")
    assert "def peak(a):" in done["p.py"][1]
    totals = edits.replacement_totals(edits.rename(files, targets, "top", "peak", dry_run=True)).first()
    assert tuple(totals) == (2, 6)
    with pytest.raises(ValueError, match="cannot name a symbol"):
        edits.rename(files, targets, "top", "9x")


def test_rename_keeps_other_lines_and_special_names(spark):
    files = spark.createDataFrame([("a", "$x x\nx $x\nx\n", "js")], FILE)
    lines = spark.createDataFrame([("a", 3), ("a", 1), ("a", 77), ("a", 1)], "filepath string, line int")
    row = edits.rename(files, lines, "x", "y$1".replace("$1", "_1")).first()
    assert row["content"] == "$y_1 y_1\nx $x\ny_1\n" and row["replacements"] == 3


EDITS = [
    ("replace", 2, 3, "new\n  deep", "a\n  new\n    deep\nd\n", 2, 3),
    ("insert_before", 2, 3, "new", "a\n  new\n\n  b\n  c\nd\n", 2, 2),
    ("insert_after", 2, 3, "new\n\nx", "a\n  b\n  c\n\n  new\n\n  x\nd\n", 5, 7),
    ("insert_after", 5, 5, "new", "a\n  b\n  c\nd\n\nnew", 6, 6),
    ("insert_before", 1, 1, "   new", "new\n\na\n  b\n  c\nd\n", 1, 1),
    ("replace", 1, 5, "z", "z", 1, 1),
]


@pytest.mark.parametrize("action,start,end,body,content,first,last", EDITS)
def test_line_edits(spark, action, start, end, body, content, first, last):
    docs = spark.createDataFrame([("f", "a\n  b\n  c\nd\n")], "filepath string, content string")
    edit = spark.createDataFrame([("f", action, start, end, body)], "filepath string, action string, start_line int, end_line int, body string")
    assert tuple(edits.apply_line_edits(docs, edit).first()) == ("f", content, first, last)


# ------------------------------------------------------------------ notes and issues


def test_notes(spark):
    docs = spark.createDataFrame([("a", "x.x y", 1), ("b", "é", 3)], "name string, content string, modified_at long")
    writes = spark.createDataFrame([("a", "old", 4), ("a", "new", 5), ("c", "c", 2)], docs.schema)
    merged = notes.upsert_docs(docs, writes)
    assert sorted(map(tuple, merged.collect())) == [("a", "new", 5), ("b", "é", 3), ("c", "c", 2)]
    assert [(r["name"], r["size"]) for r in notes.list_docs(merged).collect()] == [("a", 3), ("b", 2), ("c", 1)]
    assert notes.get_doc(docs, "a").first()["content"] == "x.x y"
    with pytest.raises(KeyError, match="no note is called"):
        notes.get_doc(docs, "zz")
    with pytest.raises(KeyError, match="no note is called"):
        notes.delete_docs(docs, spark.createDataFrame([("zz",)], "name string"), strict=True)
    edited = notes.edit_docs(docs.filter("name = 'a'"), "x", "$1", "literal").first()
    assert (edited["content"], edited["match_count"]) == ("$1.$1 y", 2)
    edited = notes.edit_docs(docs.filter("name = 'a'"), "x(.)", "[$1]", "regex").first()
    assert (edited["content"], edited["match_count"]) == ("[.][ ]y", 2)
    with pytest.raises(Exception, match="nothing in the note matches"):
        notes.edit_docs(docs, "nowhere", "", strict=True).collect()


def test_issues(spark):
    rows = [("i1", "Fix bug", None, "open", 2), ("i2", "Add x", "the BUG", "blocked", None), ("bug-3", "Zed", None, "closed", 0), ("i4", None, None, "open", 1), ("i5", "b", None, "blocked", 3)]
    table = spark.createDataFrame(rows, "id string, title string, description string, status string, priority int")
    assert tuple(issues.issue_counts(table).first()) == (2, 4, 5)
    ids = lambda df: [r["id"] for r in df.collect()]
    assert sorted(ids(issues.facet_filter(table, " bug "))) == ["bug-3", "i1", "i2"]
    assert sorted(ids(issues.facet_filter(table, priority="none"))) == ["bug-3", "i2"]
    assert ids(issues.order_issues(table)) == ["i4", "i1", "i5", "bug-3", "i2"]
    assert ids(issues.order_issues(table, "alpha-asc"))[0] == "i4"
    assert ids(issues.page(issues.order_issues(table), 2, 2)) == ["i5", "bug-3"]
    assert sorted(ids(issues.issue_view(table, "ready"))) == ["i1", "i4"]


def test_a_name_is_found_alike_among_few_and_many(spark):
    text = "a-b réel 3dx x\nab a-bc -a-b (réel)3dx b-a\n3dx"
    files = spark.createDataFrame([("f", text)], "filepath string, content string")
    asked = ["a-b", "réel", "3dx", "x"]
    want = None
    for others, bound in ((0, 100_000), (60, 100_000), (60, 10), (0, 1)):
        names = spark.createDataFrame([(n,) for n in asked + [f"other{i}" for i in range(others)]], "name string")
        got = sorted(tuple(r) for r in ops.find_occurrences(files, names, bound).collect())
        want = want or got
        assert got == want
    places = {n: sorted((r[1], r[2]) for r in want if r[3] == n) for n in asked}
    assert places == {"a-b": [(1, 0), (2, 9)], "réel": [(1, 4), (2, 14)], "3dx": [(1, 9), (2, 19), (3, 0)], "x": [(1, 13)]}


def test_found_rows_are_sent_on_by_their_size(spark):


    line = "that " * 20_000
    task = ops._token_rows(frozenset(["that"]))
    read = []

    def frames():
        for i in range(2):
            read.append(i)
            yield pa.RecordBatch.from_pydict({"filepath": [f"f{i}"], "content": [line]})

    found = task(frames())
    first = next(found)
    assert read == [0] and first.nbytes < 2 * ops.BATCH_CHARS
    rows = first.num_rows
    for batch in found:
        assert batch.nbytes < 2 * ops.BATCH_CHARS
        rows += batch.num_rows
    assert rows == 40_000
