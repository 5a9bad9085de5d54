"""Listings as tables: folders are listed by tasks, contents read by parts of about equal bytes.

The driver holds no list of files. Each step lists the folders that the one before has found, side by side, and is
stored; content is read in tasks that get files by hash, as many as the bytes ask for. Names of any form are listed,
also those that Spark's own file sources skip (``_x``, ``.x``).
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scenegrade.functions import names as N
from scenegrade.functions.schema import VIDEO_EXTENSIONS
from scenegrade.sources.store import shared_path

MANIFEST = "path string, root string, length bigint, modified timestamp, is_folder boolean"
#: Bytes that a task reads, about.
PART_BYTES = 64 << 20


def _storage(uri: str):
    """File system and path of a URI or plain path, as a task sees it; names may hold what a URI would escape."""
    from pyarrow import fs

    scheme, found, rest = uri.partition(":/")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if found else uri
    authority, _, name = rest.lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{name}"


def _listed(folders: DataFrame) -> DataFrame:
    """The entries of each folder (path, root), of the same root and, for local and URI roots alike, spelled like it."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for folder, root in zip(*(batch.column(c).to_pylist() for c in ("path", "root"))):
                system, name = _storage(folder)
                found = system.get_file_info(fs.FileSelector(name, recursive=False))
                rows = [
                    {"path": f"{folder.rstrip('/')}/{f.base_name}", "root": root, "length": f.size, "modified": f.mtime, "is_folder": f.type == fs.FileType.Directory}
                    for f in found
                ]
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 10_000], schema=kinds)

    kinds = pa.schema([("path", pa.string()), ("root", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_())])
    return folders.select("path", "root").mapInArrow(run, MANIFEST)


def manifest(spark: SparkSession, root: str, recursive: bool = True, store: str | None = None) -> DataFrame:
    """``path, root, length, modified, is_folder`` of all files below ``root``, stored level by level."""
    root, store, level = root.rstrip("/"), store or shared_path(spark, "manifest"), 0
    folders = spark.createDataFrame([(root, root)], "path string, root string")
    while True:
        found = f"{store}/level={level}"
        _listed(folders).write.parquet(found)
        entries = spark.read.schema(MANIFEST).parquet(found)
        folders = entries.filter("is_folder")
        if not recursive or folders.isEmpty():
            return spark.read.schema(MANIFEST).parquet(store).filter("NOT is_folder")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        folders, level = folders.repartition(tasks, "path"), level + 1


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``content`` (binary) of each row to the file ``name`` below ``folder``, by tasks; a name written again is replaced."""

    def run(batches):
        for batch in batches:
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("name", "content"))):
                system, path = _storage(f"{folder.rstrip('/')}/{name}")
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    rows.select("name", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def below(files: DataFrame) -> DataFrame:
    """Add ``rel_path``, the part of the path below its root."""
    return files.withColumn("rel_path", F.expr("substring(path, length(root) + 2)"))


def json_of(files: DataFrame) -> DataFrame:
    """The ``*.json`` files of a manifest with their ``file_name``."""
    return files.filter(F.col("path").endswith(".json")).withColumn("file_name", N.base_name("path"))


def media_of(files: DataFrame, extensions=VIDEO_EXTENSIONS) -> DataFrame:
    """The media files of a manifest, extension in any case, with ``rel_path``."""
    return below(files.filter(N.is_video("path", extensions)))


def with_content(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add ``content`` (NULL if a file is gone). Files are dealt by hash into as many tasks as their bytes ask for; a
    batch that a task hands on holds about ``part_bytes`` at most, or one file."""
    total = files.agg(F.sum("length")).first()[0] or 0
    spread = files.repartition(max(1, -(-total // part_bytes)), "path")
    kept = spread.columns

    def run(batches):
        for batch in batches:
            rows, content, size = [], [], 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                system, name = _storage(path)
                try:
                    with system.open_input_file(name) as file:
                        data = file.read()
                except FileNotFoundError:
                    data = None
                rows.append(k)
                content.append(data)
                size += len(data or b"")
                if size >= part_bytes or k == len(batch) - 1:
                    columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in kept]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary())], names=[*kept, "content"])
                    rows, content, size = [], [], 0

    return spread.mapInArrow(run, T.StructType([*spread.schema.fields, T.StructField("content", T.BinaryType())]))


def texts_of(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``path, file_name, text`` of a manifest's JSON files; ``text`` is NULL for bad UTF-8."""
    text = F.col("content").cast("string")
    read = with_content(json_of(files), part_bytes)
    return read.select("path", "file_name", F.when(F.is_valid_utf8(text), text).alias("text"))
