"""Reading file trees: one row per file with path, text, language and time."""

from __future__ import annotations

import errno
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.text import any_path_matches, extension_of, language_of
from passagemill.operators.symbols import REFERENCE_EXTENSIONS, SYMBOL_EXTENSIONS
from passagemill.session import new_work_path

# Files indexed by default and folders left out.
DEFAULT_INCLUDE = [
    "**/*.ts",
    "**/*.tsx",
    "**/*.js",
    "**/*.jsx",
    "**/*.py",
    "**/*.go",
    "**/*.rs",
    "**/*.java",
    "**/*.rb",
    "**/*.php",
    "**/*.c",
    "**/*.cpp",
    "**/*.h",
    "**/*.hpp",
    "**/*.cs",
    "**/*.swift",
    "**/*.kt",
]
DEFAULT_EXCLUDE = [
    "**/node_modules/**",
    "**/dist/**",
    "**/.git/**",
    "**/build/**",
    "**/target/**",
    "**/__pycache__/**",
    "**/venv/**",
    "**/.venv/**",
    "**/vendor/**",
    "**/*.min.js",
    "**/*.min.css",
]

# Left out when a tree is searched for symbols.
SYMBOL_EXCLUDE = ["node_modules/**", "dist/**", ".git/**"]

# A scan has at most this many tasks a core, and no more than give each of them so much to read.
TASKS_PER_CORE = 16
FILES_A_TASK = 256
BYTES_A_TASK = 4_000_000

# Texts pass from a task's reader in batches of about so much.
BATCH_BYTES = 4_000_000
BATCH_ROWS = 4_096

# A task that lists folders goes down into what it finds up to so many entries; folders beyond go to other tasks.
LISTED_BELOW = 10_000

LISTING = "filepath string, mtime double, size bigint"


@dataclass(frozen=True)
class _Place:
    """A folder that tasks open by themselves, through pyarrow."""

    scheme: str
    authority: str
    path: str

    def open(self) -> tuple[FileSystem, str]:
        if self.scheme == "file":
            return LocalFileSystem(), self.path
        return FileSystem.from_uri(f"{self.scheme}://{self.authority}{quote(self.path)}")


def _place(spark: SparkSession, root: str) -> _Place:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri()
    return _Place(uri.getScheme(), uri.getAuthority() or "", uri.getPath().rstrip("/"))


def _listable(place: _Place) -> bool:
    """Whether pyarrow finds the folder; a missing one is left to Spark, whose error names it."""
    try:
        files, base = place.open()
        return files.get_file_info(base or "/").type == FileType.Directory
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return False


def _hidden(name: str, is_folder: bool) -> bool:
    """Names that Spark's own readers leave out."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(files: FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether a folder, time in whole milliseconds, size) of what a folder holds.

    What went away is left out, also a link that leads nowhere; what can't be read is an error.
    """
    if not isinstance(files, LocalFileSystem):
        for info in files.get_file_info(FileSelector(folder, allow_not_found=True)):
            yield info.base_name, info.type == FileType.Directory, (info.mtime_ns or 0) // 1_000_000, info.size or 0
        return
    try:
        found = os.scandir(folder)
    except FileNotFoundError:
        return
    with found:
        for entry in found:
            try:
                entry.name.encode()  # a name that is no text has no path that Spark could hold
                stat = entry.stat()
                yield entry.name, entry.is_dir(), stat.st_mtime_ns // 1_000_000, stat.st_size
            except UnicodeEncodeError:
                continue
            except OSError as error:
                if error.errno not in (errno.ENOENT, errno.ELOOP):
                    raise


def _listed(place: _Place, below: int):
    """Folders below ``place`` to the rows of their files; a folder left for another task has no size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = place.open()
        rows: list[tuple[str, float | None, int | None]] = []

        def full() -> pa.RecordBatch:
            paths, times, sizes = zip(*rows)
            rows.clear()
            columns = [pa.array(paths, pa.string()), pa.array(times, pa.float64()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["filepath", "mtime", "size"])

        seen = 0
        for batch in batches:
            todo = batch.column("filepath").to_pylist()
            while todo:
                folder = todo.pop()
                for name, is_folder, mtime, size in _entries(files, f"{base}/{folder}" if folder else base or "/"):
                    if _hidden(name, is_folder):
                        continue
                    path = f"{folder}/{name}" if folder else name
                    seen += 1
                    if not is_folder:
                        rows.append((path, float(mtime), size))
                    elif seen < below:
                        todo.append(path)
                    else:
                        rows.append((path, None, None))
                    if len(rows) == BATCH_ROWS:
                        yield full()
        if rows:
            yield full()

    return run


def _texts(place: _Place):
    """Rows of a listing with the content of their files; one that went away is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = place.open()
        for batch in batches:
            taken, contents, held = [], [], 0
            for i, path in enumerate(batch.column("filepath")):
                try:
                    with files.open_input_file(f"{base}/{path.as_py()}") as file:
                        contents.append(file.read())
                except FileNotFoundError:
                    continue
                taken.append(i)
                held += len(contents[-1])
                if held >= BATCH_BYTES:
                    yield batch.take(pa.array(taken)).append_column("content", pa.array(contents, pa.binary()))
                    taken, contents, held = [], [], 0
            if taken:
                yield batch.take(pa.array(taken)).append_column("content", pa.array(contents, pa.binary()))

    return run


def _decoded(uri: Column) -> Column:
    return F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))


def _relative(root: str) -> Column:
    """Path below ``root``, from the file's metadata so that filters on it prune files before reading."""
    bare = re.sub(r"^[a-z0-9]+://[^/]*", "", root.removeprefix("file:")).rstrip("/")
    quoted = re.sub(r"([^\w/])", r"\\\1", bare)
    return F.regexp_replace(_decoded(F.col("_metadata.file_path")), rf"^[a-z0-9]+:(?://[^/]*)?{quoted}/", "")


def _by_spark(read: DataFrame, root: str) -> DataFrame:
    """A listing with contents, from a frame of Spark's ``binaryFile``: its driver holds every file's status."""
    return read.select(
        _relative(root).alias("filepath"),
        (F.unix_micros(F.col("_metadata.file_modification_time").cast("timestamp")) / 1000).alias("mtime"),
        F.col("_metadata.file_size").alias("size"),
        "content",
    )


def _binary(spark: SparkSession, paths: str | list[str], **options: bool) -> DataFrame:
    return spark.read.format("binaryFile").options(ignoreMissingFiles=True, **options).load(paths)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """filepath, mtime (milliseconds), size of the files below ``root``, listed now; hidden and empty ones are left out.

    The folders are listed in tasks, level by level, and the rows staged: the driver holds no file, however many there
    are. A folder of a kind that only Spark reads is listed by the driver, and its rows have the content as well.
    A file that went away is left out; one that can't be read is an error, not a gap.
    """
    place = _place(spark, root)
    if not _listable(place):
        return _by_spark(_binary(spark, root, recursiveFileLookup=True), root)
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    folders = spark.range(1, numPartitions=1).select(F.lit("").alias("filepath"))
    base, levels, left = new_work_path(spark, "listing"), [], 1
    while left:
        levels.append(f"{base}/{len(levels)}")
        folders.mapInArrow(_listed(place, LISTED_BELOW), LISTING).write.parquet(levels[-1])
        folders = spark.read.schema(LISTING).parquet(levels[-1]).filter("size IS NULL").select("filepath")
        left = folders.count()
        folders = folders.repartition(max(1, min(left, tasks)))
    return spark.read.schema(LISTING).parquet(*levels).filter("size > 0")


def is_staged(tree: DataFrame) -> bool:
    """Whether a listing is a table, whose files are opened only where they are scanned."""
    return "content" not in tree.columns


def _columns(tree: DataFrame, root: str, with_content: bool) -> DataFrame:
    """The files of a listing, opened in a bounded number of tasks."""
    spark = tree.sparkSession
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    found = tree if with_content else tree.select("filepath", "mtime", "size")
    if with_content and is_staged(tree):
        files, size = tree.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        pieces = max(1, min(tasks, max(files // FILES_A_TASK, size // BYTES_A_TASK)))
        found = tree.repartition(pieces, "filepath").mapInArrow(_texts(_place(spark, root)), f"{LISTING}, content binary")
    if with_content:
        found = found.withColumn("content", F.col("content").cast("string"))
    if not is_staged(tree):
        found = found.coalesce(tasks)
    return found.withColumn("language", language_of(extension_of(F.col("filepath"))))


def scan_corpus(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = DEFAULT_INCLUDE,
    exclude: Sequence[str] = DEFAULT_EXCLUDE,
    with_content: bool = True,
    tree: DataFrame | None = None,
    only: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Files under ``root`` that match an include glob and no exclude glob, each once.

    Without content only the listing is read. ``tree`` is a listing (``list_tree``) that several scans share;
    with ``only`` (names, or a frame of filepath) no file but the named ones is opened, of a staged listing.
    """
    path = F.col("filepath")
    tree = list_tree(spark, root) if tree is None else tree
    found = tree.filter(any_path_matches(path, include) & ~any_path_matches(path, exclude))
    if isinstance(only, DataFrame):
        found = found.join(only.select("filepath"), "filepath", "left_semi")
    elif only is not None:
        found = found.filter(path.isin(list(only)))
    return _columns(found, root, with_content)


def read_files(spark: SparkSession, root: str, filepaths: Sequence[str]) -> DataFrame:
    """Only the named files below ``root``; the rest of the tree is not touched."""
    quoted = [re.sub(r"([*?\[\]{}\\])", r"\\\1", f"{root.rstrip('/')}/{p}") for p in filepaths]
    return _columns(_by_spark(_binary(spark, quoted), root), root, True)


def file_stats(
    spark: SparkSession,
    root: str,
    include: Sequence[str] = DEFAULT_INCLUDE,
    exclude: Sequence[str] = DEFAULT_EXCLUDE,
) -> DataFrame:
    """filepath, mtime (milliseconds), size; no file is opened."""
    return scan_corpus(spark, root, include, exclude, with_content=False).select("filepath", "mtime", "size")


def _by_extension(
    spark: SparkSession, root: str, extensions: Sequence[str], exclude: Sequence[str], path: str | None = None
) -> DataFrame:
    name = F.col("filepath")
    keep = F.regexp_extract(name, r"(\.[^./]*)$", 1).isin(*extensions) & ~any_path_matches(name, exclude)
    if path:
        keep = keep & ((name == path.rstrip("/")) | F.startswith(name, F.lit(path.rstrip("/") + "/")))
    return _columns(list_tree(spark, root).filter(keep), root, True)


def scan_for_symbols(spark: SparkSession, root: str, path: str | None = None) -> DataFrame:
    """Files with symbols: the whole tree, a folder or one file.

    Three folders at the top of what is searched are left out, and whatever is hidden.
    """
    top = f"{path.rstrip('/')}/" if path else ""
    exclude = [*(top + glob for glob in SYMBOL_EXCLUDE), "**/.*", "**/.*/**"]
    return _by_extension(spark, root, SYMBOL_EXTENSIONS, exclude, path)


def scan_for_references(spark: SparkSession, root: str) -> DataFrame:
    return _by_extension(spark, root, REFERENCE_EXTENSIONS, DEFAULT_EXCLUDE)


def write_texts(texts: DataFrame, root: str) -> int:
    """Write a file for every row (filepath below ``root``, content), in the tasks that hold the rows; how many.

    The folder must be of a kind that pyarrow knows, else ``pyarrow.ArrowInvalid`` is raised. A file of the same
    path is replaced.
    """
    place = _place(texts.sparkSession, root)
    place.open()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = place.open()
        made, n = set(), 0
        for batch in batches:
            for path, text in zip(batch.column("filepath"), batch.column("content")):
                target = f"{base}/{path.as_py()}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(target) as out:
                    out.write(text.as_py().encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    counted = texts.select("filepath", "content").mapInArrow(write, "n bigint").agg(F.sum("n"))
    return counted.first()[0] or 0
