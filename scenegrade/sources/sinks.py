"""Writers for reports, documents and split manifests. Folders are storage that driver and executors share."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from scenegrade.operators.rates import latency_lines
from scenegrade.operators.validate import CSV_ERROR_LIMIT
from scenegrade.plans.leaderboard import details, flat_report, model_summary, ranked


def _csv_ready(df: DataFrame) -> DataFrame:
    """Booleans as True/False, as the flat reports spell them."""
    booleans = [name for name, kind in df.dtypes if kind == "boolean"]
    return df.withColumns({b: F.initcap(F.col(b).cast("string")) for b in booleans})


def _write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep)
    writer.option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_per_video_scores(scores: DataFrame, out: str) -> None:
    """``per_video_scores`` as Parquet with the full error lists and as flat CSV, whose layout has the first 30 errors."""
    scores.write.mode("overwrite").parquet(f"{out}/per_video_scores.parquet")
    stored = scores.sparkSession.read.parquet(f"{out}/per_video_scores.parquet")
    in_order = flat_report(stored, CSV_ERROR_LIMIT).orderBy("video", "model", "student_path")  # files in this order, too
    _write_csv(_csv_ready(in_order), f"{out}/per_video_scores.csv")


def write_model_summary(summary: DataFrame, out: str) -> None:
    """Ranked ``model_summary``: one row per model, so one file."""
    _write_csv(ranked(summary).coalesce(1), f"{out}/model_summary.csv")


def write_details(scores: DataFrame, out: str) -> None:
    details(scores).write.mode("overwrite").json(f"{out}/details.json")


def write_reports(scores: DataFrame, out: str, weighted: bool = False) -> DataFrame:
    """All reports of a scoring job. Scores are computed once; table, CSV, summary and details come from the stored ones."""
    write_per_video_scores(scores, out)
    stored = scores.sparkSession.read.parquet(f"{out}/per_video_scores.parquet")
    write_model_summary(model_summary(stored, weighted), out)
    write_details(stored, out)
    return stored


def write_gold_documents(documents: DataFrame, out: str) -> None:
    """Integrated or status documents keyed by ``stem``, partitioned by ``status``."""
    documents.write.mode("overwrite").partitionBy("status").parquet(out)


def append_results(results: DataFrame, out: str) -> None:
    """Append the result documents of calls (path, model) without a stored one; writing a batch again adds nothing."""
    new = results.dropDuplicates(["path", "model"])
    try:
        stored = results.sparkSession.read.schema(results.schema).parquet(out)
        new = new.join(stored.select("path", "model"), ["path", "model"], "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.mode("append").partitionBy("model").parquet(out)


def write_latency(latency: DataFrame, out: str) -> None:
    lines = latency_lines(latency).orderBy("position").drop("position")
    _write_csv(lines.withColumnRenamed("success_total", "success/total").coalesce(1), out, sep="\t")


def write_split(split: DataFrame, out: str) -> None:
    """Split manifest with one folder per split."""
    split.write.mode("overwrite").partitionBy("split").parquet(out)


def write_chat_examples(examples: DataFrame, out: str) -> None:
    """Chat examples as JSON lines."""
    examples.select("messages").write.mode("overwrite").json(out)
