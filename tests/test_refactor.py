import pytest

from passagemill.plans import refactor


@pytest.fixture
def root(tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/a.py").write_text("class Box:\n    def size(self):\n        return 1\n\ndef size():\n    return Box().size()\n")
    (tmp_path / "main.py").write_text("from pkg.a import size\nprint(size(), oversize)\n")
    (tmp_path / "node_modules/b.py").write_text("size\n")
    (tmp_path / "notes.md").write_text("size\n")
    return str(tmp_path)


def test_references_and_rename(spark, root):
    found = refactor.references_to(spark, root, "/size", "pkg/a.py")
    assert sorted((r["filepath"], r["line"], r["column"]) for r in found.collect()) == [
        ("main.py", 1, 18), ("main.py", 2, 6), ("pkg/a.py", 2, 8), ("pkg/a.py", 6, 17)
    ]
    dry = refactor.rename_symbol(spark, root, "/size", "pkg", "length", dry_run=True)
    assert {r["filepath"]: r["replacements"] for r in dry.collect()} == {"main.py": 2, "pkg/a.py": 3}
    done = {r["filepath"]: r["content"] for r in refactor.rename_symbol(spark, root, "/size", "pkg/a.py", "length").collect()}
    assert done["main.py"] == "from pkg.a import length\nprint(length(), oversize)\n"
    with pytest.raises(ValueError, match="defines no"):
        refactor.rename_symbol(spark, root, "nothing", "pkg/a.py", "x")
    with pytest.raises(ValueError, match="cannot name a symbol"):
        refactor.rename_symbol(spark, root, "/size", "pkg/a.py", "not valid")


def test_edits(spark, root):
    row = refactor.edit_symbol(spark, root, "Box/size", "pkg/a.py", "insert_before", "def width(self):\n    return 2").first()
    assert row["content"].startswith("class Box:\n    def width(self):\n        return 2\n\n    def size(self):")
    assert (row["new_start"], row["new_end"]) == (2, 3)
    row = refactor.edit_symbol(spark, root, "/size", "pkg/a.py", "replace", "def size():\n    return 0\n").first()
    assert row["content"].endswith("        return 1\n\ndef size():\n    return 0\n")
    with pytest.raises(ValueError, match="action"):
        refactor.edit_symbol(spark, root, "/size", "pkg/a.py", "drop", "")
