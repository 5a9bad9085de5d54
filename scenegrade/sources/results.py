"""Stored results of model calls as a bucketed table: pending calls meet it without moving it, batches replace themselves.

The table is bucketed by (path, model), Spark's own ``CLUSTERED BY``, and has a folder for each batch. A batch is written as
a whole over its folder, so writing it again, also after a failed try, stores it once.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from scenegrade.operators.calls import planned_calls

CALL = ["path", "model"]
BUCKETS = 64


def open_results(spark: SparkSession, table: str, folder: str, columns: str = "document string, status string", buckets: int = BUCKETS) -> DataFrame:
    """Register the result table ``table`` over ``folder``, which may be new or hold results already; returns it."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (path string, model string, {columns}, batch string) USING parquet"
        f" PARTITIONED BY (batch) CLUSTERED BY (path, model) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


def write_batch(results: DataFrame, table: str, batch: str) -> None:
    """Store the results of a batch (path, model, and the table's columns), one per call, in place of what the batch held."""
    spark = results.sparkSession
    columns = [c for c in spark.table(table).columns if c != "batch"]
    rows = results.dropDuplicates(CALL).select(*columns, F.lit(batch).alias("batch"))
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)


def pending_of(media: DataFrame, models, table: str) -> DataFrame:
    """Planned calls without a stored result. Only the planned side is exchanged, into the table's buckets."""
    done = media.sparkSession.table(table).select(*CALL)
    return planned_calls(media, models).join(done.hint("merge"), CALL, "left_anti")
