"""Stored documents: parsed once, kept as VARIANT with their flags, and read leaf by leaf.

A store is a Parquet table of the document's own columns (names, keys), ``json_ok``, ``parse_ok`` and ``obj``. Jobs over
it parse nothing: Spark pushes the paths a plan reads into the scan, so other leaves are not even assembled, and flags
such as the validity of a run come from narrow columns.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from scenegrade.functions import json_docs as J
from scenegrade.operators import consensus as C

#: Leaves are pushed into the scan, and objects written with their common paths as columns of their own.
SETTINGS = {"spark.sql.variant.pushVariantIntoScan": "true", "spark.sql.variant.writeShredding.enabled": "true"}
RUN_COLUMNS = ["stem", "run", "digits", "padding", "file_name", "valid", "reject_reason", "json_ok", "parse_ok", "obj"]


def configure_store(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that driver and executors share, which the session names in ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share, or pass a path")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with ``obj``: those of a store as they are, texts parsed."""
    return docs if {"obj", "parse_ok", "json_ok"} <= set(docs.columns) else J.parse_documents(docs, text)


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists", text: str = "text") -> DataFrame:
    """Parse the texts once and store the documents at ``path``; the texts are left out. Returns the stored table."""
    spark = docs.sparkSession
    configure_store(spark)
    kept = [c for c in docs.columns if c not in (text, "json_ok", "parse_ok", "obj")]
    parsed(docs, text).select(*kept, "json_ok", "parse_ok", "obj").write.mode(mode).parquet(path)
    return read_documents(spark, path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store. Reading some columns or leaves reads nothing else."""
    configure_store(spark)
    return spark.read.parquet(path)


def write_runs(files: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Store the teacher runs among ``files`` (file_name, text): parsed and checked once, with why a run is rejected.

    Counts of valid runs and lists of rejected ones come from the narrow columns of the store, the votes from its
    documents: no later job parses or checks a run again. Appended runs join those stored.
    """
    configure_store(files.sparkSession)
    checked = C.with_validity(parsed(C.gather_runs(files)))
    checked.select(*RUN_COLUMNS).write.mode(mode).parquet(path)
    return read_documents(files.sparkSession, path)


def stored_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None before anything is written there."""
    try:
        return read_documents(spark, path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
