"""Helpers that the operators of this subpackage share."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bound on what one Arrow batch carries to a Python worker, in rows.
BATCH_ROWS = 512
#: Ids that a broadcast may hold; beyond, the join is a shuffle.
BROADCAST_IDS = 2_000_000


def configure(spark: SparkSession) -> SparkSession:
    """Settings the Python operators rely on: small Arrow batches, as one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the storage that driver and executors share, which the session names in `spark.checkpoint.dir`."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, before: set[str]) -> None:
    """Removes what has come into the shared folder since `stored_names` gave `before`: the intermediates of a run whose
    result is stored elsewhere. Not for folders that other jobs write to at the same time."""
    for name in stored_names(spark) - before:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored_names(spark: SparkSession) -> set[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    system = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return {f.getPath().getName() for f in system.listStatus(root)} if system.exists(root) else set()


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """`df` written as Parquet to shared storage and read again: lineage ends here, lost executors lose nothing."""
    path = path or shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by exact name, under new names; other columns may clash with them in any way."""
    names = df.columns
    unique = df.toDF(*[f"_{i}" for i in range(len(names))])
    return unique.select([F.col(f"_{names.index(source)}").alias(name) for name, source in columns.items()])


def with_row(df: DataFrame, without: str | None = None, **columns: str) -> DataFrame:
    """`pick`, plus the row as a struct with positional field names (but for column `without`), for `open_row`."""
    names = df.columns
    unique = df.toDF(*[f"_{i}" for i in range(len(names))])
    left_out = names.index(without) if without else -1
    row = F.struct(F.lit(True).alias("any"), *[F.col(f"_{i}") for i in range(len(names)) if i != left_out]).alias("row")
    return unique.select(*[F.col(f"_{names.index(source)}").alias(n) for n, source in columns.items()], row)


def open_row(df: DataFrame, like: DataFrame, **instead) -> DataFrame:
    """The rows that `with_row` packed, with the columns of `like`; `instead` gives those that were left out."""
    found = {like.columns.index(name): value for name, value in instead.items()}
    values = [found.get(i, F.col(f"row._{i}")).alias(f"_{i}") for i in range(len(like.columns))]
    return df.select(values).toDF(*like.columns)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column without nulls, as numpy views."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return o - (o[0] if len(o) else 0), d[o[0] : o[-1]] if len(o) else d


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, one range after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def gathered(batches, column: str, size: int):
    """The rows of the batches in fewer ones: each is closed once the strings of `column` reach `size` bytes."""
    held, held_size = [], 0
    for batch in batches:
        held.append(batch)
        held_size += batch.column(column).nbytes
        if held_size >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, held_size = [], 0
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tasks_for(df: DataFrame) -> int:
    """Partitions for an explicit exchange: the session's number of shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def open_storage(uri: str):
    """File system and path of a URI, as tasks see it: local paths, and what pyarrow knows (HDFS, object stores)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)
