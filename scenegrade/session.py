"""Session settings the library relies on."""

from pyspark.sql import SparkSession

# allowDuplicateKeys: a JSON object with a repeated key keeps the last one.
# hugeMethodLimit: projections over ~80 document paths exceed what the JIT
# compiles as one method; above this size Spark splits them into small methods.
RUNTIME_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe to call repeatedly."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
