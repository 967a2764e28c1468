"""Source files as rows (repo_id, path, ext, text).

Files are read whole as bytes; those that are not UTF-8 are left out, and line ends become \\n, as a
text-mode reader would have them. Which files belong to a repository depends on the analysis: see
POLICIES. Null paths are left out; an empty folder gives no rows.
"""

from __future__ import annotations

import itertools
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.plans.shared import ship, stored

#: The file name endings of each analysis.
FOUR = (".py", ".java", ".cpp", ".js")
EIGHT = (".py", ".java", ".cpp", ".js", ".ts", ".c", ".h", ".hpp")
PRUNED = (".git", "__pycache__", "venv", "node_modules")
#: Bytes of files that a task hands on at once, about.
READ_BYTES = 16 << 20
POLICIES = ("metrics", "wide", "explorer", "python", "reviewer")
SCHEMA = "repo_id string, path string, ext string, text string"


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | path.endswith(e)
    return out


def belongs(path: Column, policy: str) -> Column:
    """metrics: four endings; wide: eight; explorer: eight in any case, without pruned folders;
    reviewer: eight in any case; python: .py."""
    if policy == "metrics":
        return _ends(path, FOUR)
    if policy == "wide":
        return _ends(path, EIGHT)
    if policy == "python":
        return path.endswith(".py")
    if policy == "reviewer":
        return _ends(F.lower(path), EIGHT)
    if policy == "explorer":
        folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
        return _ends(F.lower(path), EIGHT) & ~F.arrays_overlap(folders, F.array(*map(F.lit, PRUNED)))
    raise ValueError(f"no policy {policy!r}; there are {', '.join(POLICIES)}")


def decoded(content: Column) -> Column:
    """Bytes as text with \\n line ends, null where they are not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "\r\n?", "\n"))


def _rows(raw: DataFrame, unreadable: bool = False) -> DataFrame:
    """unreadable: files that are not UTF-8 stay, with null texts."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("ext")
    rows = raw.select("repo_id", "path", ext, decoded(F.col("content")).alias("text"))
    return rows if unreadable else rows.where(F.col("text").isNotNull())


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", root).rstrip("/")
    fs, base = pafs.FileSystem.from_uri(root)
    return fs, base.rstrip("/")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a folder, or of a file that root names itself ("" is its path).

    Spark's own file index leaves out names that begin with _ or a dot, and empty files, so executors
    list the folders: all those of a level at once, then what they hold.
    """
    ship(spark)
    names = ["path", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                top = f"{base}/{folder}" if folder else base
                if not folder and fs.get_file_info(base).type == pafs.FileType.File:
                    found = [fs.get_file_info(base)]
                else:
                    # A root that isn't there is an error; a folder that went meanwhile is empty.
                    found = fs.get_file_info(pafs.FileSelector(top, allow_not_found=bool(folder)))
                paths = [x.path[len(base) + 1 :] for x in found]
                sizes = [x.size if x.type == pafs.FileType.File else -1 for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names)

    folders, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        listed = stored(folders.repartition("path").mapInArrow(run, "path string, length long"))
        files = listed.where("length >= 0")
        found = files if found is None else found.unionByName(files)
        folders = listed.where("length < 0").select("path")
        if folders.isEmpty():
            return found


def _contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of files (path), opened where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        for batch in batches:
            paths, contents, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{path}" if path else base) as f:
                    contents.append(f.read())
                paths.append(path)
                held += len(contents[-1])
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return files.select("path").repartition("path").mapInArrow(run, "path string, content binary")


def read_folder(spark: SparkSession, root: str, repo_id: str | None = "repo", endings: tuple[str, ...] | None = EIGHT, unreadable: bool = False) -> DataFrame:
    """Files below a folder that all executors reach, a path or a URI. Without a repo_id the folders in
    root are the repositories. Only files with one of the endings, in any case, are opened; None reads all."""
    found = walk(spark, root)
    if endings is not None:
        found = found.where(_ends(F.lower("path"), endings))
    rows = _contents(found, root)
    if repo_id is not None:
        return _rows(rows.select(F.lit(repo_id).alias("repo_id"), "path", "content"), unreadable)
    rows = rows.select(F.substring_index("path", "/", 1).alias("repo_id"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "content")
    return _rows(rows, unreadable)


def read_zips(spark: SparkSession, root: str) -> DataFrame:
    """The files inside zip archives below root, each archive a repository named by its path there.
    Nothing is unpacked to a disk, so no file of an earlier archive stays behind."""
    archives = walk(spark, root).where(F.lower("path").endswith(".zip") | (F.col("path") == "")).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}" if name else base) as f, zipfile.ZipFile(f) as z:
                    for x in z.infolist():
                        if not x.is_dir():
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([x.filename]), pa.array([z.read(x)], pa.binary())], ["repo_id", "path", "content"])

    return _rows(archives.repartition("path").mapInArrow(run, "repo_id string, path string, content binary"))


def write_folder(files: DataFrame, root: str) -> DataFrame:
    """Files (repo_id, path, content binary) written below root/repo_id by the executors; returns
    (repo_id, path, n_bytes). root is a URI that all of them reach; a task that runs again writes the
    same files again."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for repo, path, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = f"{base}/{repo}/{path}"
                folder = name.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(name) as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["repo_id", "path", "n_bytes"])

    return stored(files.select("repo_id", "path", "content").mapInArrow(run, "repo_id string, path string, n_bytes long"))


def write_zips(files: DataFrame, root: str) -> DataFrame:
    """Each repository of files (repo_id, path, content binary) as an archive root/repo_id.zip, written
    by the task that has all of it; returns (repo_id, n_files)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        fs.create_dir(base, recursive=True)
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        for repo, group in itertools.groupby(rows, key=lambda r: r[0]):
            n = 0
            with fs.open_output_stream(f"{base}/{repo}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for _, path, content in group:
                    z.writestr(zipfile.ZipInfo(path), content or b"")
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([repo]), pa.array([n], pa.int64())], ["repo_id", "n_files"])

    rows = files.select("repo_id", "path", "content").repartition("repo_id").sortWithinPartitions("repo_id", "path")
    return stored(rows.mapInArrow(run, "repo_id string, n_files long"))


def from_table(df: DataFrame, repo: str = "source", path: str = "doc_id", text: str = "text", ext: str = ".py") -> DataFrame:
    """Rows of a table as files; null texts are left out."""
    rows = df.select(F.col(repo).cast("string").alias("repo_id"), F.concat(F.col(path).cast("string"), F.lit(ext)).alias("path"), F.lit(ext).alias("ext"), F.col(text).alias("text"))
    return rows.where(F.col("text").isNotNull())


def upload(spark: SparkSession, name: str, content: bytes) -> DataFrame:
    """One uploaded file; its line ends stay as they are."""
    return spark.createDataFrame([("upload", name, "." + name.rpartition(".")[2], content.decode())], SCHEMA)


def concatenated(files: DataFrame) -> DataFrame:
    """(repo_id, n_files, text): each repository's files below headers with their base names, by path.
    Files that could not be read (null texts) count, but add nothing. For single repositories: a row
    holds all of one."""
    base = F.regexp_extract("path", "([^/]*)$", 1)
    part = F.struct("path", F.concat(F.lit("\n\n# FILE: "), base, F.lit("\n\n"), F.col("text")).alias("s"))
    rows = files.where(belongs(F.col("path"), "metrics")).groupBy("repo_id")
    rows = rows.agg(F.count(F.lit(1)).alias("n_files"), F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), part))).alias("p"))
    return rows.select("repo_id", "n_files", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("text"))
