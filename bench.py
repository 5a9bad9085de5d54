"""Headline timings; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from checks import registry
from scenegrade import configure
from scenegrade.fixtures import documents as D
from scenegrade.operators import rates
from scenegrade.operators.agreement import run_agreement
from scenegrade.operators.validate import with_validation
from scenegrade.plans import gold as G
from scenegrade.plans import leaderboard as L
from scenegrade.sources import store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session():
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", str(4 * int(CPUS)))
    )
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = session()
    folder = tempfile.mkdtemp(prefix="bench-")  # derived document texts, written untimed
    texts = {"gold": D.gold_texts, "students": D.student_texts, "runs": D.run_texts}
    for name, make in texts.items():
        make(spark, SF_DIR).write.parquet(f"{folder}/{name}")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    stored = lambda name: store.read_documents(spark, f"{folder}/{name}_store")
    jobs = {  # the stores are written first, as jobs of their own: nothing after them parses a text
        "store_documents": lambda: [store.write_documents(read(n), f"{folder}/{n}_store") for n in ("gold", "students")] and None,
        "store_runs": lambda: store.write_runs(read("runs").select("file_name", "text"), f"{folder}/runs_store") and None,
        "score": lambda: L.model_summary(L.per_video_scores(stored("gold"), stored("students"))),
        "validation_rates": lambda: rates.dataset_rates(with_validation(stored("students"))),
        "consensus": lambda: G.gold_documents(stored("runs"), 3),
        "agreement": lambda: run_agreement(stored("runs")),
    }
    for name in ["student_name_match", "exact_split", "call_outcomes", "pending_calls", "mask_and_truncate"]:
        jobs[name] = lambda name=name: registry.QUERIES[name](spark, SF_DIR)
    timings, control = {}, []
    for _ in range(2):  # an unchanged query that tells the speed of the machine; the second run counts
        start = time.time()
        drain(spark.range(30_000_000).selectExpr("sum(xxhash64(sha2(CAST(id AS STRING), 256)) % 1000) AS s"))
        control.append(round(time.time() - start, 3))
    for name, job in jobs.items():
        start = time.time()
        done = job()
        if done is not None:
            drain(done)
        timings[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "control_seconds": control[-1], "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
