import re

import pytest
from pyspark.sql import functions as F

from passagemill.functions import kinds, names, text
from passagemill.functions.text import glob_to_regex, keyword_score

SCORES = [
    ("hello world", "foo bar", "test.ts", 0.0),
    ("hello world", "hello world function", "test.ts", 1.0),
    ("hello world", "hello foo", "test.ts", 0.75),
    ("a ab abc", "abc only", "test.ts", 1.0),
    ("a ab", "a ab", "test.ts", 0.0),
    ("user", "getUserData", "test.ts", 1.0),
    ("auth", "function here", "auth.ts", 0.5),
    ("auth user login", "auth only", "test.ts", 0.5),
    ("", "some content", "test.ts", 0.0),
    ("file.test", "file.test content", "test.ts", 1.0),
    ("file.test", "fileXtest content", "test.ts", 0.0),
    ("(open", "an (open bracket", "test.ts", 1.0),
    ("réel", "c'est réel ici", "test.ts", 1.0),
    ("el", "réel", "test.ts", 0.0),
]


@pytest.mark.parametrize("query,content,path,score", SCORES)
def test_keyword_score(spark, query, content, path, score):
    df = spark.createDataFrame([(content, path)], "c string, p string")
    assert df.select(keyword_score(query, F.col("c"), F.col("p"))).first()[0] == pytest.approx(score)


GLOBS = [
    ("*.ts", "app.ts", True),
    ("*.ts", "src/app.ts", False),
    ("**/*.ts", "app.ts", True),
    ("**/*.ts", "src/a/app.ts", True),
    ("src/**", "src/app.ts", True),
    ("src/**", "src/a/b/app.ts", True),
    ("src/**", "lib/app.ts", False),
    ("src/*", "src/a/app.ts", False),
    ("**/*.ts", ".hidden/app.ts", False),
    ("*", ".env", False),
    (".env", ".env", True),
    (".*", ".env", True),
    ("src/?.js", "src/a.js", True),
    ("src/?.js", "src/ab.js", False),
    ("*.{ts,tsx}", "a.tsx", True),
    ("*.{ts,tsx}", "a.jsx", False),
    ("{src,lib}/**/*.py", "lib/x/y.py", True),
    ("src/[a-c]x.py", "src/bx.py", True),
    ("src/[!a-c]x.py", "src/bx.py", False),
    ("**/node_modules/**", "a/node_modules/b/c.js", True),
    ("a+b(1).txt", "a+b(1).txt", True),
    ("**", "a/b", True),
]


@pytest.mark.parametrize("glob,path,matches", GLOBS)
def test_glob(spark, glob, path, matches):
    assert bool(re.search(glob_to_regex(glob), path)) is matches
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(text.path_matches(F.col("p"), glob)).first()[0] is matches
    assert df.select(text.path_matches(F.col("p"), "!" + glob)).first()[0] is not matches


def test_language_and_directory(spark):
    df = spark.createDataFrame([("a/b/x.tsx",), ("x.zig",), ("Makefile",), (".env",), ("d.x/y",)], "p string")
    ext = text.extension_of(F.col("p"))
    got = df.select(ext, text.language_of(ext), text.directory_of(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [
        ("tsx", "typescript", "a/b"), ("zig", "zig", None), ("", "", None), ("", "", None), ("", "", "d.x")
    ]


def test_blank_and_trim_use_all_white_space(spark):
    nbsp = chr(0xA0)
    df = spark.createDataFrame([(" \t\n" + nbsp,), (nbsp + "x ",)], "t string")
    got = df.select(text.is_blank(F.col("t")), text.trimmed(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, ""), (False, "x")]


PATHS = [
    ("/MyClass/myMethod", "/MyClass/myMethod", None, True),
    ("/MyClass/myMethod", "/OtherClass/myMethod", None, False),
    ("/MyClass/myMethod", "myMethod", None, True),
    ("/MyClass/myMethod", "MyClass/myMethod", None, True),
    ("/MyClass/myMethod", "/myMethod", None, False),
    ("/MyClass/getValue", "get*", None, True),
    ("/MyClass/GetValue", "MyClass/get*", None, True),
    ("/MyClass/getValue", "get*", False, False),
    ("/MyClass/getValue", "get", True, True),
    ("/MyClass/getValue", "Value", True, False),
    ("/MyClass/m", "/MyClass/m[2]", None, True),
    ("/a", "", None, True),
    ("a", "a/b", None, False),
    ("/a/b", "//a//b", None, True),
]


@pytest.mark.parametrize("path,pattern,prefix,matches", PATHS)
def test_name_path(spark, path, pattern, prefix, matches):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(names.match_name_path(F.col("p"), pattern, prefix)).first()[0] is matches


def test_parse_name_path():
    p = names.parse_name_path(" /A/get*[3] ")
    assert (p.parts, p.absolute, p.prefix, p.overload) == (("A", "get"), True, True, 3)
    assert names.parse_name_path("a[x]").parts == ("a[x]",)


def test_kinds(spark):
    assert kinds.kind_number("typeparameter") == 26 and kinds.kind_number("nope") is None
    table = {r["kind"]: r["kind_name"] for r in kinds.kinds_table(spark).collect()}
    assert table[5] == "Class" and len(table) == 26
    df = spark.createDataFrame([("class",), ("import",), ("section",)], "t string")
    assert [r[0] for r in df.select(kinds.chunk_type_kind(F.col("t"))).collect()] == [5, 2, 13]


class _Session:
    """Stands in for a session: a setting, a master and an application id."""

    def __init__(self, setting, master):
        self.conf = {"spark.sql.warehouse.dir": "file:/w"} | ({"spark.checkpoint.dir": setting} if setting else {})
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{setting}-{master}"})


def test_work_dir_comes_from_the_session():
    from passagemill.session import work_dir

    assert work_dir(_Session("hdfs://shared/x/", "yarn")) == "hdfs://shared/x"
    assert work_dir(_Session(None, "local[2]")) == "file:/w/passagemill-work"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(_Session(None, "spark://host:7077"))


def test_scratch_tables_go_with_their_block(spark):
    import os
    from urllib.parse import urlparse

    from passagemill.session import Scratch, stage

    exists = lambda path: os.path.exists(urlparse(path).path)
    with Scratch(spark) as own:
        kept = stage(own.stage(spark.range(5), "numbers").where("id > 2"), "kept")
        assert all(map(exists, own.paths)) and len(own.paths) == 1
    assert not any(map(exists, own.paths)) and {r.id for r in kept.collect()} == {3, 4}
    with pytest.raises(ZeroDivisionError), Scratch(spark) as own:
        own.stage(spark.range(1), "numbers")
        raise ZeroDivisionError
    assert not any(map(exists, own.paths))


def test_identifiers(spark):
    from passagemill.operators.edits import valid_identifier

    df = spark.createDataFrame([("a_1",), ("_",), ("1a",), ("a b",), ("a\n",), ("é",), ("",)], "n string")
    assert [r[0] for r in df.select(valid_identifier(F.col("n"))).collect()] == [True, True] + [False] * 5
