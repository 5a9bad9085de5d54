"""Bucketed results, resumable calls, listings by tasks, exact splits and names of many tokens."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenegrade.operators import calls, naming
from scenegrade.operators import trainset as T
from scenegrade.operators.leaves import with_leaves
from scenegrade.operators import features as FE
from scenegrade.functions import json_docs as J
from scenegrade.sources import manifest, results


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_of_results_replace_themselves(spark, tmp_path):
    name = f"results_{uuid.uuid4().hex}"
    results.open_results(spark, name, f"{tmp_path}/results", buckets=4)
    rows = [(f"/m/{k}.mp4", m, f'{{"k":{k}}}', "ok") for k in range(50) for m in ("a", "b")]
    df = spark.createDataFrame([*rows, rows[0]], "path string, model string, document string, status string")
    results.write_batch(df.filter("model = 'a'"), name, "1")
    results.write_batch(df.filter("model = 'b'").limit(7), name, "2")  # a try that stored a part only
    with pytest.raises(Exception, match="no answer"):
        results.write_batch(df.filter("model = 'b'").withColumn("status", F.when(F.col("path") == "/m/9.mp4", F.raise_error(F.lit("no answer"))).otherwise("ok")), name, "2")
    for _ in range(2):
        results.write_batch(df.filter("model = 'b'"), name, "2")
    assert spark.table(name).count() == 100 and spark.table(name).select("path", "model").distinct().count() == 100
    media = spark.createDataFrame([(f"/m/{k}.mp4",) for k in range(60)], "path string")
    pending = results.pending_of(media, ["a", "b", "c"], name)
    assert pending.count() == 60 + 2 * 10
    left, right = plan(pending).split("SortMergeJoin")[1].split("FileScan")[0], "FileScan" + plan(pending).split("FileScan")[1]
    assert plan(pending).count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in right and "Exchange" in left
    again = f"results_{uuid.uuid4().hex}"  # another session finds the stored batches
    assert results.open_results(spark, again, f"{tmp_path}/results", buckets=4).count() == 100


def test_calls_resume_where_they_failed(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    fail_at = tmp_path / "fail"
    fail_at.write_text("x")

    def model_call(batch):
        out = []
        for path, model in zip(batch["path"], batch["model"]):
            if path == "/m/17" and fail_at.exists():
                raise RuntimeError("lost")
            (log / uuid.uuid4().hex).write_text(f"{path} {model}")
            out.append({"response_text": f"{path}!", "elapsed_s": 0.5, "usage": None if path == "/m/3" else {"total_token_count": len(path)}})
        return pd.DataFrame(out)

    pending = spark.createDataFrame([(f"/m/{k}", "a", k) for k in range(30)], "path string, model string, k int").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        with pytest.raises(Exception, match="lost"):
            calls.batch_call(pending, model_call, answers=f"{tmp_path}/answers").collect()
        made = sorted(p.read_text() for p in log.iterdir())
        assert len(made) == 17  # the failed batch has called two more than are stored
        fail_at.rename(tmp_path / "over")
        rows = calls.batch_call(pending, model_call, answers=f"{tmp_path}/answers").orderBy("k").collect()
        assert len(list(log.iterdir())) == 30 + 2  # of the 15 stored answers none is called again
        assert [(r["path"], r["response_text"], r["elapsed_s"]) for r in rows] == [(f"/m/{k}", f"/m/{k}!", 0.5) for k in range(30)]
        assert rows[3]["usage"] is None and rows[4]["usage"] == {"total_token_count": 4}
        calls.batch_call(pending.repartition(3), model_call, answers=f"{tmp_path}/answers").collect()
        assert len(list(log.iterdir())) == 32
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_manifest_lists_every_file_once(spark, tmp_path):
    names = [f"d{k % 7}/e{k % 3}/{k}.{('json', 'MP4', 'txt')[k % 3]}" for k in range(900)] + ["_hidden.json", ".dot.mp4", "top é.json", "d0/x.json/y.json", "empty.json"]
    rows = spark.createDataFrame([(n, None if n == "empty.json" else f"[{k}]".encode()) for k, n in enumerate(names)], "name string, content binary")
    manifest.write_files(rows.repartition(4), f"{tmp_path}/files")
    (tmp_path / "files" / "nothing").mkdir()
    (tmp_path / "files" / "bad.json").write_bytes(b"\xff")
    files = manifest.manifest(spark, f"{tmp_path}/files/")
    found = {r["rel_path"]: r["length"] for r in manifest.below(files).collect()}
    assert set(found) == {*names, "bad.json"} and found["empty.json"] == 0 and files.count() == len(found)
    assert {r["rel_path"] for r in manifest.media_of(files).collect()} == {n for n in names if n.lower().endswith(".mp4")}
    texts = {r["path"].split("/files/")[1]: r["text"] for r in manifest.texts_of(files, part_bytes=40).collect()}
    assert texts == {**{n: f"[{k}]" for k, n in enumerate(names) if n.endswith(".json")}, "empty.json": "", "bad.json": None}
    flat = manifest.below(manifest.manifest(spark, f"{tmp_path}/files", recursive=False))
    assert {r["rel_path"] for r in flat.collect()} == {n for n in found if "/" not in n}
    assert manifest.manifest(spark, f"{tmp_path}/files/nothing").count() == 0


@pytest.mark.parametrize("ratio", [0.8, 0.5, 0.01])
def test_splits_are_exact_with_null_and_repeated_keys(spark, tmp_path, ratio):
    for n, keys in enumerate(([None] * 3, [], ["a"], ["hot"] * 700 + [None] * 200 + [f"k{k}" for k in range(100)], [str(k) for k in range(1000)])):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "stem string, i int").repartition(3)
        split = T.exact_split(df, ratio, store=f"{tmp_path}/{n}").collect()
        assert sorted(r["i"] for r in split) == list(range(len(keys)))
        assert sum(r["split"] == "train" for r in split) == int(len(keys) * ratio)
    nulls_last = [r["split"] for r in spark.read.parquet(f"{tmp_path}/3").withColumn("split", F.lit(1)).filter("stem IS NULL").collect()]
    assert len(nulls_last) == 200


def test_names_of_many_tokens(spark):
    tokens = [f"t{k}" for k in range(200)]
    name = "_".join(tokens) + ".json"
    files = spark.createDataFrame([(f"/r/{name}", name), ("/r/a_b_a_b_m.json", "a_b_a_b_m.json")], "path string, file_name string")
    ids = ["t5", "t198", "t199", "t3_t4_t5", "_".join(tokens[:199]), "_".join(tokens), "a_b", "b"]
    gold = spark.createDataFrame([(i,) for i in ids], "video_id string")
    found = {(r["path"], r["video_id"]): r["model"] for r in naming.match_students(files, gold).collect()}
    long = f"/r/{name}"
    assert found == {
        (long, "t5"): "_".join(tokens[6:]), (long, "t198"): "t199", (long, "t3_t4_t5"): "_".join(tokens[6:]), (long, "_".join(tokens[:199])): "t199",
        ("/r/a_b_a_b_m.json", "a_b"): "a_b_m", ("/r/a_b_a_b_m.json", "b"): "a_b_m",
    }
    assert naming.match_students(files, gold.limit(0)).count() == 0
    assert [r["position"] for r in naming.sorted_students(spark.createDataFrame([("p", "v", "b"), ("q", "v", "a"), ("r", "w", "c")], "path string, video_id string, model string")).orderBy("path").collect()] == [2, 1, 1]


def test_a_document_of_very_many_events_and_lanes(spark):
    n = 20_000
    events = ",".join(f'{{"event_type":"e{k % 50}","involved_vehicle_type":"car","risk_level":"low","count":{k % 3}}}' for k in range(n))
    lanes = ",".join(f'{{"lane_id":{k % 400},"status":{{"value":"s{k}"}},"vehicle_density":{{"value":null}}}}' for k in range(n))
    text = f'{{"traffic_status":[{lanes}],"vehicle_events":[{events}]}}'
    row = FE.with_features(with_leaves(J.parse_documents(spark.createDataFrame([(text,)], "text string")))).select("veh_sums", "veh_zero", "n_lanes", "ts_len", "lane_facts", "lane_unknown").first()
    sums = {}
    for k in range(n):
        sums[f"e{k % 50}"] = sums.get(f"e{k % 50}", 0) + k % 3
    assert sorted(row["veh_sums"]) == sorted(f'{s}:"{e}","car","low"' for e, s in sums.items()) and row["veh_zero"] == []
    assert (row["n_lanes"], row["ts_len"]) == (400, n)
    assert {x for x in row["lane_facts"] if "=" in x} == {f'{k % 400}:s="s{k}"' for k in range(n - 400, n)} and len(row["lane_unknown"]) == 400
