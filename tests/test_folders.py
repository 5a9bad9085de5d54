"""Readers, writers and whole folder jobs on small folders."""

import json

from pyspark.sql import functions as F

from scenegrade.operators import rates
from scenegrade.operators import trainset as T
from scenegrade.plans.evaluate import collect_examples, integrate_folder, score_folders, score_tables
from scenegrade.sources import files as S
from scenegrade.sources import sinks
from tests.test_documents import base


def test_scores_are_written(spark, tmp_path):
    gold, results, out = tmp_path / "gold", tmp_path / "results", str(tmp_path / "out")
    gold.mkdir()
    results.mkdir()
    (gold / "a.json").write_text(json.dumps(base()))
    for i in (1, 2):
        (gold / f"a.teacher.perception_raw.run_{i}.json").write_text(json.dumps(base()))
    (results / "a_m1.json").write_text(json.dumps(base()))
    (results / "a_m2.json").write_text("{")
    scores, summary = score_folders(spark, str(gold), str(results), ["m1", "m2"], None, True, "plain")
    sinks.write_per_video_scores(scores, out)
    sinks.write_model_summary(summary, out)
    sinks.write_details(scores, out)
    rows = {r.model: r for r in spark.read.option("header", True).csv(f"{out}/per_video_scores.csv").collect()}
    assert len(rows["m1"]) == 20 and rows["m1"].parse_ok == "True" and rows["m2"].parse_ok == "False"
    assert rows["m2"].global_slot_macro_acc is None and abs(float(rows["m1"].teacher_consensus_weight) - 1) < 1e-9
    ranked = spark.read.option("header", True).csv(f"{out}/model_summary.csv").collect()
    assert [r.model for r in ranked] == ["m1", "m2"] and len(ranked[0]) == 18
    assert abs(float(ranked[0].weight_global_slot_macro_acc_mean) - 1) < 1e-9
    details = spark.read.json(f"{out}/details.json").filter("model = 'm2'").first()
    assert details.validation.errors == ["parse_failed_or_not_object"]


def test_runs_are_integrated(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"v.teacher.perception_raw.run_{i}.json").write_text(json.dumps(base()))
    (tmp_path / "other.json").write_text("{}")
    row = integrate_folder(spark, str(tmp_path)).first()
    assert row.file_name == "v.teacher.perception_integrated.json" and row.status == "integrated"
    document = json.loads(row.document)
    assert document["road_composition"]["number_of_lanes"] == {"visible": True, "value": 1, "confidence": 0.5}
    assert [x["lane_id"] for x in document["traffic_status"]] == [1]


def test_examples_from_trees_and_metadata(spark, tmp_path):
    videos, labels = tmp_path / "v", tmp_path / "l"
    (videos / "s").mkdir(parents=True)
    (labels / "s").mkdir(parents=True)
    for name in ("a.MP4", "b.webm", "c.txt"):
        (videos / "s" / name).write_bytes(b"x")
    (labels / "s" / "a.json").write_text('{"k": 1}')
    examples, rejects = collect_examples(spark, str(videos), str(labels))
    assert [(r.video, r.label) for r in examples.collect()] == [(f"{videos}/s/a.MP4", '{"k":1}')]
    assert rejects.count() == 0
    (labels / "metadata.jsonl").write_text('{"video":"x.mp4","label":"y"}\n\n{"video":["a","b"],"label":"y"}\n')
    examples, rejects = collect_examples(spark, str(videos), str(labels))
    assert [(r.video, r.label) for r in examples.collect()] == [(f"{videos}/x.mp4", "y")]
    assert rejects.first().reason == "expected_one_video"
    urls = S.media_data_urls(S.media_files(spark, str(videos), content=True)).orderBy("path").collect()
    assert urls[0].data_url == "data:video/mp4;base64,eA=="


def test_latency_split_and_details(spark, tmp_path):
    calls = spark.createDataFrame([("m", True, 1.0), ("m", False, None)], "model string, ok boolean, elapsed_s double")
    models = spark.createDataFrame([("m", 1, True), ("n", 2, False)], "model string, position int, init_ok boolean")
    latency = rates.mean_latency(calls, models, spark.range(3).agg(F.count("*").alias("n")))
    sinks.write_latency(latency, str(tmp_path / "t"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines == ["model\tavg_elapsed_s\tsuccess/total\tnotes", "m\t1.0000\t1/2\t", "n\tNA\t0/3\tinit_failed"]
    split = T.exact_split(spark.range(5).selectExpr("CAST(id AS STRING) AS stem"), 0.5)
    sinks.write_split(split, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'train'").count() == 2


def test_integrated_documents_are_scored_from_tables(spark, tmp_path):
    runs, out = tmp_path / "runs", str(tmp_path / "gold")
    runs.mkdir()
    for video, n in (("v", 2), ("w", 1)):
        for i in range(1, n + 1):
            (runs / f"{video}.teacher.perception_raw.run_{i}.json").write_text(json.dumps(base()))
    sinks.write_gold_documents(integrate_folder(spark, str(runs), 2), out)
    results = spark.createDataFrame(
        [(f"/r/{name}", name, json.dumps(base())) for name in ("question_v_m1.json", "w_m1.json", "x_m1.json", "v_m2.json")],
        "path string, file_name string, text string",
    )
    gold = spark.read.parquet(out)
    scores, _ = score_tables(gold, results, S.json_files(spark, str(runs)), ["m1"])
    stored = sinks.write_reports(scores, str(tmp_path / "out"), weighted=True)
    rows = {r.video: r for r in stored.collect()}
    assert set(rows) == {"v", "w"} and rows["v"].traffic_status_macro_acc == 1.0
    summary = spark.read.option("header", True).csv(f"{tmp_path}/out/model_summary.csv").collect()
    assert [(r.model, r.n_videos) for r in summary] == [("m1", "2")]
    limited, _ = score_tables(gold, results, None, None, 1)
    assert {r.video for r in limited.select("video").collect()} == {"v"}


def test_texts_are_parsed_after_the_name_join(spark, tmp_path):
    (tmp_path / "v_m1.json").write_text(json.dumps(base()))
    scores, _ = score_folders(spark, str(tmp_path), str(tmp_path), ["m1"])
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    parses = [k for k, line in enumerate(lines) if "Generate" in line and "_wrapped" in line]
    assert len(parses) == 2  # gold and student documents

    def below(k):
        stop = next((i for i in range(k + 1, len(lines)) if depth[i] <= depth[k]), len(lines))
        return lines[k + 1 : stop]

    assert sum(any("Join Inner" in line for line in below(k)) for k in parses) == 1


def test_results_are_appended_once(spark, tmp_path):
    batch = spark.createDataFrame([("/a.mp4", "m", "{}"), ("/a.mp4", "m", "{}")], "path string, model string, document string")
    for _ in range(2):
        sinks.append_results(batch, f"{tmp_path}/r")
    more = spark.createDataFrame([("/a.mp4", "m", "{}"), ("/b.mp4", "n", "{}")], "path string, model string, document string")
    sinks.append_results(more, f"{tmp_path}/r")
    assert sorted((r.path, r.model) for r in spark.read.parquet(f"{tmp_path}/r").collect()) == [("/a.mp4", "m"), ("/b.mp4", "n")]
