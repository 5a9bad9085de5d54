"""Readers for folders of JSON documents, media and metadata lines.

Folders are read with the ``binaryFile`` source: one row per file, bytes only when a
plan uses them. Spark skips files whose names start with ``_`` or ``.``; producers
must not use such names.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scenegrade.functions import json_docs as J
from scenegrade.functions import names as N
from scenegrade.functions.responses import data_url
from scenegrade.functions.schema import VIDEO_EXTENSIONS


def _files(spark: SparkSession, folder: str, recursive: bool, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def below_root(path, root: str) -> Column:
    """Part of a path below ``root``, which may be absolute, relative or a URI: it is qualified as Spark qualifies it."""
    spark = SparkSession.getActiveSession()
    given = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    full = system.makeQualified(given).toUri().toString()
    full = ("/" + full[5:].lstrip("/") if full.startswith("file:") else full).rstrip("/")
    whole, length = J.col(path), F.length(J.col(path))
    return F.when(whole.startswith(full + "/"), F.substring(whole, F.lit(len(full) + 2), length)).otherwise(
        F.substring(whole, F.lit(len(root.rstrip("/")) + 2), length)
    )


def json_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, file_name, text`` of the ``*.json`` files; ``text`` is NULL for bad UTF-8.

    Selecting no ``text`` lists names without reading content.
    """
    files = _files(spark, folder, recursive, "*.json")
    text = F.col("content").cast("string")
    return files.select(
        "path", N.base_name("path").alias("file_name"), F.when(F.is_valid_utf8(text), text).alias("text")
    )


def gold_files(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """Gold documents with ``video_id`` from the file name.

    By default every JSON file is a gold document. ``kind='integrated'`` keeps only
    integrated documents and drops their suffix from the id; ``kind='plain'`` keeps
    the files that are neither runs nor integrated documents.
    """
    files = json_files(spark, folder).withColumn("video_id", N.strip_json("file_name"))
    integrated = F.col("video_id").endswith(N.INTEGRATED_SUFFIX)
    if kind == "integrated":
        files = files.filter(integrated).withColumn(
            "video_id", F.expr(f"left(video_id, length(video_id) - {len(N.INTEGRATED_SUFFIX)})")
        )
    elif kind == "plain":
        files = files.filter(~integrated & N.teacher_run_stem("file_name").isNull())
    return files.withColumnRenamed("path", "teacher_path").select("video_id", "teacher_path", "text")


def teacher_run_files(spark: SparkSession, folder: str) -> DataFrame:
    """``stem, path, text`` of the teacher-run files of either naming."""
    return json_files(spark, folder).withColumn("stem", N.teacher_run_stem("file_name")).filter("stem is not null")


def media_files(
    spark: SparkSession, folder: str, extensions=VIDEO_EXTENSIONS, recursive: bool = True, content: bool = False
) -> DataFrame:
    """``path, rel_path, length`` (and ``content``) of the media files, extension in any case."""
    files = _files(spark, folder, recursive).filter(N.is_video("path", extensions))
    columns = ["path", below_root("path", folder).alias("rel_path"), "length"]
    return files.select(*columns, *(["content"] if content else []))


def media_data_urls(media: DataFrame) -> DataFrame:
    """Add ``data_url`` to media rows read with content."""
    return media.withColumn("data_url", data_url(N.extension("path"), "content"))


def metadata_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a ``metadata.jsonl`` file as ``value``."""
    return spark.read.text(path)


def has_metadata(spark: SparkSession, folder: str, name: str = "metadata.jsonl") -> bool:
    """Whether a label folder holds a metadata file, which then wins over tree pairing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder)
    return not found.select("path").isEmpty()

