import os
import time

import pytest
from pyspark.sql import functions as F

from passagemill.operators import changes
from passagemill.operators.embedding import HashEmbedder
from passagemill.plans.index_job import CorpusIndex
from passagemill.sources import files as tree
from passagemill.sources.store import ChunkStore, lookup, read_json_record, read_many_json

FILES = "filepath string, mtime double"


def frame(spark, rows):
    return spark.createDataFrame(rows, FILES)


@pytest.mark.parametrize(
    "now,then,reason",
    [
        ([("a", 1000.0)], [("a", 1000.0)], None),
        ([("a", 900.0)], [("a", 1000.0)], None),
        ([("a", 2000.0)], [("a", 1000.0)], "1 modified file(s)"),
        ([("a", 1000.0), ("b", 1.0)], [("a", 1000.0)], "1 new file(s)"),
        ([("a", 1000.0)], [("a", 1000.0), ("b", 1.0)], "1 deleted file(s)"),
        ([("a", 2.0), ("c", 1.0)], [("a", 1.0), ("b", 1.0)], "1 new file(s), 1 modified file(s), 1 deleted file(s)"),
    ],
)
def test_staleness(spark, now, then, reason):
    row = changes.staleness(changes.detect_changes(frame(spark, now), frame(spark, then))).first()
    assert (row["stale"], row["reason"]) == (reason is not None, reason)


def test_checksum_depends_on_paths_and_count_only(spark):
    df = frame(spark, [(f"p{i}", 0.0) for i in range(20)])
    digest = changes.index_checksum(df, 5).first()[0]
    assert len(digest) == 16
    assert changes.index_checksum(df.repartition(7), 5).first()[0] == digest
    assert changes.index_checksum(df, 6).first()[0] != digest
    assert changes.index_checksum(df.filter("filepath <> 'p3'"), 5).first()[0] != digest



# ------------------------------------------------------------------ files and index runs


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "my tree+1"
    for name, text in {
        "src/a/x.py": "import os\n\ndef hello():\n    return 'hi'\n",
        "src/b.ts": "export function foo() {\n}\n",
        "src/long.kt": "\n".join(f"line {i}" for i in range(250)),
        "node_modules/q/z.js": "no",
        ".hidden/z.js": "no",
        "lib/app.min.js": "no",
        "README.md": "text",
    }.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return base


def contents(index):
    return sorted((r["id"], r["content"]) for r in index.store.load_chunks().collect())


def test_scan(spark, root):
    assert sorted(r["filepath"] for r in tree.scan_corpus(spark, str(root)).collect()) == ["src/a/x.py", "src/b.ts", "src/long.kt"]
    only = tree.scan_corpus(spark, str(root), ["**/*.ts", "src/*.ts", "*.md"], ["src/a/**"])
    assert sorted(r["filepath"] for r in only.collect()) == ["README.md", "src/b.ts"]
    stats = {r["filepath"]: (r["size"], r["mtime"]) for r in tree.file_stats(spark, str(root)).collect()}
    real = os.stat(root / "src/b.ts")
    assert stats["src/b.ts"][0] == real.st_size and abs(stats["src/b.ts"][1] - real.st_mtime * 1000) < 1000
    assert [r["filepath"] for r in tree.scan_for_symbols(spark, str(root), "src/a").collect()] == ["src/a/x.py"]
    assert sorted(r["filepath"] for r in tree.scan_for_references(spark, str(root)).collect()) == ["src/a/x.py", "src/b.ts", "src/long.kt"]


def test_listing_reads_no_contents(spark, root):
    plan = tree.file_stats(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan.split("ReadSchema")[-1]


def touch(path, text, ahead):
    path.write_text(text)
    later = time.time() + ahead
    os.utime(path, (later, later))


def test_incremental_equals_full(spark, root, tmp_path):
    index = CorpusIndex(spark, str(root), str(tmp_path / "store"))
    assert index.staleness().first()["reason"] == "nothing is indexed yet"
    first = index.index()
    assert (first.files_indexed, first.incremental) == (3, False)
    assert not index.staleness().first()["stale"]
    assert index.index().files_indexed == 0
    touch(root / "src/b.ts", "export function bar() {\n}\n", 10)
    (root / "src/new.py").write_text("def fresh():\n    pass\n")
    os.remove(root / "src/a/x.py")
    assert index.staleness().first()["reason"] == "1 new file(s), 1 modified file(s), 1 deleted file(s)"
    second = index.index()
    assert (second.files_indexed, second.incremental) == (2, True)
    full = CorpusIndex(spark, str(root), str(tmp_path / "full"))
    full.index()
    assert contents(index) == contents(full)
    checksum = lambda i: i.store.load_record().first()["checksum"]
    assert checksum(index) == checksum(full)
    assert not index.verdict().first()["corrupted"] and not index.mismatch().first()["mismatch"]
    assert index.status().first()["file_count"] == 3


def test_repair_and_model_change(spark, root, tmp_path):
    index = CorpusIndex(spark, str(root), str(tmp_path / "store"))
    index.index()
    index.store.delete_by_key(spark.createDataFrame([("src/b.ts",)], "filepath string"))
    assert "The record counts" in index.verdict().first()["reason"]
    assert index.index(auto_repair=True).repaired
    assert not index.verdict().first()["corrupted"]
    wider = CorpusIndex(spark, str(root), str(tmp_path / "store"), HashEmbedder(32))
    assert " wide, those of " in wider.mismatch().first()["reason"]
    assert not wider.index().incremental
    assert not wider.mismatch().first()["mismatch"]


def test_resume_after_a_failed_stage(spark, root, tmp_path):
    class Failing(HashEmbedder):
        def __call__(self, texts):
            raise RuntimeError("service down")

    with pytest.raises(Exception, match="service down"):
        CorpusIndex(spark, str(root), str(tmp_path / "store"), Failing()).index()
    resumed = CorpusIndex(spark, str(root), str(tmp_path / "store")).index()
    assert resumed.resumed and resumed.files_indexed == 3
    full = CorpusIndex(spark, str(root), str(tmp_path / "full"))
    full.index()
    assert contents(CorpusIndex(spark, str(root), str(tmp_path / "store"))) == contents(full)


def test_stale_stage_is_dropped(spark, root, tmp_path):
    class Failing(HashEmbedder):
        def __call__(self, texts):
            raise RuntimeError("service down")

    with pytest.raises(Exception, match="service down"):
        CorpusIndex(spark, str(root), str(tmp_path / "store"), Failing()).index()
    touch(root / "src/b.ts", "export function later() {\n}\n", 10)
    result = CorpusIndex(spark, str(root), str(tmp_path / "store")).index()
    assert not result.resumed
    ids = [r["id"] for r in CorpusIndex(spark, str(root), str(tmp_path / "store")).store.load_chunks().collect()]
    assert "src/b.ts:1-3:later" in ids


def test_concepts_are_kept_while_the_checksum_holds(spark, root, tmp_path):
    index = CorpusIndex(spark, str(root), str(tmp_path / "store"))
    index.index()
    assert index.concepts(k=2)[1].count() == 2
    path = tmp_path / "store/concepts/clusters"
    stamp = os.stat(path).st_mtime_ns
    index.concepts(k=2)
    assert os.stat(path).st_mtime_ns == stamp
    (root / "src/new.py").write_text("def fresh():\n    pass\n")
    index.index()
    index.concepts(k=2)
    assert os.stat(path).st_mtime_ns != stamp


def test_store_replaces_only_touched_buckets(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=16)
    rows = [(f"f{i}:1-1", f"f{i}", f"text {i}") for i in range(40)]
    chunks = spark.createDataFrame(rows, "id string, filepath string, content string").select(
        "*", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("en").alias("language"),
        F.lit(None).cast("string").alias("symbol_type"), F.lit(None).cast("string").alias("symbol_name"),
        F.array(F.lit(1.0)).alias("embedding"),
    )
    store.write_chunks(chunks)
    before = {p.name: os.stat(p).st_mtime_ns for p in (tmp_path / "s/chunks").glob("bucket=*")}
    store.replace_files(spark.createDataFrame([("f3",)], "filepath string"), chunks.filter("filepath = 'f3'").withColumn("content", F.lit("new")))
    after = {p.name: os.stat(p).st_mtime_ns for p in (tmp_path / "s/chunks").glob("bucket=*")}
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.count_rows() == 40 and lookup(store.load_chunks(), ["f3:1-1"]).first()["content"] == "new"
    store.delete_by_key(spark.createDataFrame([(f"f{i}",) for i in range(39)], "filepath string"))
    assert [r["filepath"] for r in store.load_chunks().collect()] == ["f39"]
    store.append_chunks(chunks.filter("filepath = 'f1'"))
    assert store.count_rows() == 2
    store.clear()
    assert not store.exists()


def test_json_records(spark, tmp_path):
    schema = "command string, count long"
    from pyspark.sql.types import StructType

    typed = StructType.fromDDL(schema)
    assert read_json_record(spark, str(tmp_path / "none.json"), typed).count() == 0
    for agent, text in {"a": '{"command":"x","count":2}', "b": "broken {", "c": '{"command":"y","count":3}'}.items():
        (tmp_path / agent).mkdir()
        (tmp_path / agent / "usage.json").write_text(text)
    got = read_many_json(spark, f"{tmp_path}/*/usage.json", typed).orderBy("command").collect()
    assert [(r["command"], r["count"]) for r in got] == [("x", 2), ("y", 3)] and "/a/usage.json" in got[0]["source"]


def test_bucket_count_is_fitted_and_remembered(spark, tmp_path):
    from passagemill.sources import store as store_module

    assert [store_module.buckets_for(n) for n in (0, 16_000_000, 16_000_001, 10**9)] == [16, 16, 32, 1024]
    chunks = spark.createDataFrame([("a:1-1", "a")], "id string, filepath string").select(
        "*", *[F.lit(None).alias(f.name) for f in store_module.CHUNK_SCHEMA if f.name not in ("id", "filepath")]
    )
    ChunkStore(spark, str(tmp_path / "s"), buckets=5).write_chunks(chunks)
    assert ChunkStore(spark, str(tmp_path / "s")).buckets == 5
    with pytest.raises(ValueError, match="no chunk table"):
        ChunkStore(spark, str(tmp_path / "none")).buckets


def test_named_files_with_glob_characters(spark, root):
    (root / "src/a[1]{b}.py").write_text("x = 1")
    (root / "src/a1.py").write_text("y = 1")
    got = tree.read_files(spark, str(root), ["src/a[1]{b}.py", "src/b.ts"]).orderBy("filepath").collect()
    assert [(r["filepath"], r["language"]) for r in got] == [("src/a[1]{b}.py", "python"), ("src/b.ts", "typescript")]
    listed = {r["filepath"] for r in tree.file_stats(spark, str(root)).collect()}
    assert "src/a[1]{b}.py" in listed


def test_questions_to_an_index(spark, root, tmp_path):
    index = CorpusIndex(spark, str(root), str(tmp_path / "store"))
    assert index.search("hello").first()["id"] == "src/a/x.py:3-5:hello"  # indexes first
    touch(root / "src/b.ts", "export function farewell() {\n}\n", 10)
    assert index.search("farewell function", path_glob="src/*.ts").first()["id"] == "src/b.ts:1-3:farewell"
    assert index.search("farewell", languages=["Python"]).filter("language <> 'python'").count() == 0

    near = index.search_similar(filepath="src/a/x.py", start_line=3, end_line=5)
    assert near.filter("filepath = 'src/a/x.py' AND start_line = 3").count() == 0 and near.count() > 0
    whole = index.search_similar(filepath="src/a/x.py", start_line=3, end_line=5, exclude_self=False)
    assert (whole.first()["id"], whole.first()["similarity"]) == ("src/a/x.py:3-5:hello", 1.0)
    assert index.search_similar(code="export function farewell() {\n}").filter("filepath = 'src/b.ts'").count() == 0
    assert index.search_similar(filepath="src/b.ts", limit=2).count() == 2
    with pytest.raises(ValueError, match="give a text"):
        index.search_similar()
    with pytest.raises(ValueError, match="blank"):
        index.search_similar(code=" \n")

    _, clusters = index.concepts(k=2)
    first = clusters.filter("cluster_id = 0").first()
    assert [r["id"] for r in index.search_by_concept(0).collect()] == first["representative_ids"]
    members = {r["id"] for r in index.concepts()[0].filter("cluster_id = 0").collect()}
    assert {r["id"] for r in index.search_by_concept(0, "line").collect()} <= members
    facts = {(r["fact"], r["item"]): r["value"] for r in index.summary().collect()}
    assert facts["total", "files"] == 3 and facts["total", "chunks"] == index.store.count_rows()


def test_symbols_are_searched_in_all_but_three_folders(spark, tmp_path):
    for name in ("a.py", "build/b.py", "dist/c.py", "x/dist/d.py", "node_modules/e.py", ".h/f.py", "g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = lambda *a: sorted(r["filepath"] for r in tree.scan_for_symbols(spark, str(tmp_path), *a).collect())
    assert found() == ["a.py", "build/b.py", "x/dist/d.py"]
    assert found("x") == [] and found("build") == ["build/b.py"]


def test_every_text_is_embedded_once(spark, tmp_path, monkeypatch):
    from passagemill.operators.embedding import HashEmbedder, embed

    calls = spark.sparkContext.accumulator(0)

    class Counting(HashEmbedder):
        def __call__(self, texts):
            calls.add(len(texts))
            return super().__call__(texts)

    monkeypatch.setattr("passagemill.session.work_dir", lambda spark: str(tmp_path / "work"))
    rows = [(f"f{i}:1-1", f"f{i}", f"text {i}") for i in range(40)]
    plain = spark.createDataFrame(rows, "id string, filepath string, content string").select(
        "*", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("en").alias("language"),
        F.lit(None).cast("string").alias("symbol_type"), F.lit(None).cast("string").alias("symbol_name"),
    )
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.write_chunks(embed(plain, "content", Counting()))
    assert calls.value == 40 and store.count_rows() == 40
    store.replace_files(plain.select("filepath").limit(5), embed(plain.limit(5), "content", Counting()))
    assert calls.value == 45 and store.count_rows() == 40
    assert not any((tmp_path / "work").iterdir())


def test_changed_files_are_read_in_slices(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr("passagemill.plans.index_job.NAMED_FILES", 2)
    index = CorpusIndex(spark, str(root), str(tmp_path / "store"))
    index.index()
    for i in range(5):
        (root / f"src/more{i}.py").write_text(f"def more{i}():\n    pass\n")
    assert index.index().files_indexed == 5
    full = CorpusIndex(spark, str(root), str(tmp_path / "full"))
    full.index()
    assert contents(index) == contents(full)


def test_a_run_lists_the_tree_once(spark, root, tmp_path, monkeypatch):
    from passagemill.plans import index_job

    calls = []
    monkeypatch.setattr(index_job, "list_tree", lambda *a: calls.append(a) or tree.list_tree(*a))
    monkeypatch.setattr(tree, "_tree", lambda *a: pytest.fail("listed again"), raising=False)
    index = CorpusIndex(spark, str(root), str(tmp_path / "store"))
    index.index()
    assert len(calls) == 1
    touch(root / "src/b.ts", "export function bar() {\n}\n", 10)
    assert index.index().files_indexed == 1 and len(calls) == 2


def test_a_scan_of_many_small_files_has_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "TASKS_PER_CORE", 1)
    for i in range(300):
        (tmp_path / f"f{i}.py").write_text(f"x = {i}\n")
    found = tree.scan_corpus(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert found.count() == 300
    some = tree.scan_corpus(spark, str(tmp_path), only=["f7.py", "f9.py", "none.py"])
    assert sorted(r["content"] for r in some.collect()) == ["x = 7\n", "x = 9\n"]


def test_texts_become_files_without_a_folder_each(spark, sf, tmp_path):
    from catalog import runs

    runs._write_tree(spark, sf, f"file://{tmp_path}/tree", "lang <> 'fr'")
    runs._write_tree(spark, sf, f"{tmp_path}/tree", "lang = 'fr'")
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    folders = documents.select("source", "lang").distinct().count()
    assert sum(1 for _, below, files in os.walk(tmp_path / "tree") if files) == folders
    got = tree.scan_corpus(spark, str(tmp_path / "tree"), ["**/*.txt"], []).select(runs._doc(), "content")
    want = {r["doc_id"]: (r["text"] or "") + "\n" for r in documents.collect()}
    assert {r["doc_id"]: r["content"] for r in got.collect()} == want and got.count() == len(want)


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b c.txt", "é\n"), ("a/d%2F.txt", "x")], "filepath string, content string")
    assert tree.write_texts(rows, str(tmp_path / "t")) == 2 and tree.write_texts(rows.limit(0), str(tmp_path / "t")) == 0
    assert (tmp_path / "t/a/b c.txt").read_text() == "é\n" and (tmp_path / "t/a/d%2F.txt").read_text() == "x"
    assert {r["filepath"] for r in tree.file_stats(spark, str(tmp_path / "t"), ["**/*"], []).collect()} == {"a/b c.txt", "a/d%2F.txt"}


def walked(root):
    found = (os.path.relpath(os.path.join(folder, name), root) for folder, _, names in os.walk(root) for name in names)
    return sorted(found)


def test_the_driver_holds_no_file_of_a_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "LISTED_BELOW", 20, raising=False)  # so that several rounds list it
    for i in range(300):
        path = tmp_path / f"t/d{i % 7}/e{i % 3}/f{i}.py"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"x = {i}\n")
    listing = tree.list_tree(spark, f"{tmp_path}/t")
    assert len(listing.inputFiles()) < 50
    found = tree.scan_corpus(spark, f"{tmp_path}/t", tree=listing)
    assert len(found.inputFiles()) < 50
    got = {r["filepath"]: r["content"] for r in found.collect()}
    assert sorted(got) == walked(tmp_path / "t") and all(text == f"x = {path.split('/f')[1][:-3]}\n" for path, text in got.items())
    some = spark.createDataFrame([("d0/e0/f0.py",), ("d1/e1/f1.py",), ("none.py",)], "filepath string")
    assert sorted(r["content"] for r in tree.scan_corpus(spark, f"{tmp_path}/t", tree=listing, only=some).collect()) == ["x = 0\n", "x = 1\n"]


def test_a_listing_is_that_of_sparks_readers(spark, tmp_path):
    root = tmp_path / "a tree+%20é"
    for name in ("a.py", "k=_v/_a=b.py", "_h/c.py", "_metadata_d/f.py", "_metadata_f.py", ".h/x.py", "s/.h.py", "c.py._COPYING_", "s p+%2F é.py", "d#x/q?.py", "d/" * 30 + "z.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "empty.py").write_text("")
    (root / "none").mkdir()
    os.symlink("k=_v", root / "link")
    os.symlink("nowhere", root / "broken.py")
    (root / "bytes.py").write_bytes(b"\xff\x00a")
    spark_read = tree._by_spark(tree._binary(spark, str(root), recursiveFileLookup=True), str(root))
    want = sorted(map(tuple, tree.scan_corpus(spark, str(root), ["**/*"], [], tree=spark_read).collect()))
    assert len(want) == 8
    assert sorted(map(tuple, tree.scan_corpus(spark, str(root), ["**/*"], []).collect())) == want
    assert sorted(map(tuple, tree.file_stats(spark, str(root), ["**/*"], []).collect())) == [r[:3] for r in want]


def test_a_file_that_went_away_is_left_out_and_one_that_cannot_be_read_fails(spark, tmp_path):
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("x")
    found = tree.scan_corpus(spark, str(tmp_path))
    os.remove(tmp_path / "a.py")
    assert [r["filepath"] for r in found.collect()] == ["b.py"]
    os.remove(tmp_path / "b.py")
    (tmp_path / "b.py").mkdir()
    with pytest.raises(Exception, match="b.py"):
        found.collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tree.list_tree(spark, f"{tmp_path}/none")


def test_changed_files_do_not_pass_the_driver(spark, root, tmp_path, monkeypatch):
    index = CorpusIndex(spark, str(root), str(tmp_path / "store"))
    listing = index.changes(tree.list_tree(spark, str(root)))
    collect = type(listing).collect

    def counted(frame):
        assert "filepath" not in frame.columns, "paths were collected"
        return collect(frame)

    monkeypatch.setattr(type(listing), "collect", counted)
    found = index._changed_files(listing, tree.list_tree(spark, str(root)))
    assert sorted(r["filepath"] for r in collect(found)) == ["src/a/x.py", "src/b.ts", "src/long.kt"]


def test_concepts_of_a_tree_that_the_driver_never_lists(spark, root, tmp_path, monkeypatch):
    reader = type(spark.read)
    by_format = reader.format
    monkeypatch.setattr(reader, "format", lambda self, kind: pytest.fail("listed by the driver") if kind == "binaryFile" else by_format(self, kind))
    index = CorpusIndex(spark, str(root), str(tmp_path / "store"))
    assert index.index().files_indexed == 3
    first = {tuple(r) for r in index.concepts(k=2)[0].select("id", "cluster_id").collect()}
    assert len(first) == index.store.count_rows()
    assert {tuple(r) for r in index.concepts(k=2)[0].select("id", "cluster_id").collect()} == first
