"""Names, responses, splits and masks."""

import pytest
from pyspark.sql import functions as F

from scenegrade.functions import names as N
from scenegrade.functions.responses import first_json_object
from scenegrade.operators import naming
from scenegrade.operators import trainset as T
from scenegrade.operators.naming import match_students


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x")).first()[0]


@pytest.mark.parametrize(
    "stem,model",
    [("question_a_06m07s_qwen_8B", "qwen_8B"), ("question_a_06m07s", "06m07s"), ("a_1m2s_b_3m4s_c", "c"), ("x_y", "y")],
)
def test_model_from_stem(spark, stem, model):
    assert one(spark, stem, N.model_from_stem) == model


@pytest.mark.parametrize("text,out", [("x.", "x"), ("a b/ç", "a_b"), ("...", "result")])
def test_sanitize(spark, text, out):
    assert one(spark, text, N.sanitize) == out


@pytest.mark.parametrize(
    "text,out",
    [('note {"a":1} end', '{"a":1}'), (' {"a":{}} ', '{"a":{}}'), ("x {{}", None), ("none", None), ('a {"b":{"c":1}} {"d":2}', '{"b":{"c":1}}')],
)
def test_first_json_object(spark, text, out):
    assert one(spark, text, first_json_object) == out


def test_one_file_matches_several_ids(spark):
    files = spark.createDataFrame([("/r/q_a_b_qwen_8B.json", "q_a_b_qwen_8B.json")], "path string, file_name string")
    ids = spark.createDataFrame([("a",), ("a_b",), ("z",)], "video_id string")
    rows = {(r.video_id, r.model) for r in match_students(files, ids).collect()}
    assert rows == {("a", "b_qwen_8B"), ("a_b", "qwen_8B")}


def test_a_hot_reading_is_split(spark, monkeypatch):
    """A reading of most names that passes the filter of the ids, which is full, does not stay in one task."""
    monkeypatch.setattr(naming, "WORDS", 1)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 2000, 1, 4).selectExpr("concat('cam_', id) AS video_id")
        files = ids.selectExpr("concat('/r/question_', video_id, '_m.json') AS path", "concat('question_', video_id, '_m.json') AS file_name")
        matched = match_students(files, ids)
        found = {(r["video_id"], r["model"]) for r in matched.collect()}
        assert found == {(f"cam_{k}", "m") for k in range(2000)}
        assert "skew=true" in matched._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_exact_split(spark):
    counts = T.exact_split(spark.range(10).selectExpr("CAST(id AS STRING) AS stem"), 0.8).groupBy("split").count()
    assert {r.split: r["count"] for r in counts.collect()} == {"train": 8, "test": 2}


def test_truncate_and_mask(spark):
    rows = spark.createDataFrame([(list(range(10)), 2), (list(range(10)), 5), ([1, 2, 3], 2)], "input_ids array<int>, prefix_len int")
    kept, rejected = T.truncate_and_mask(rows, 3, 2)
    assert sorted((r.input_ids, r.labels) for r in kept.collect()) == [
        ([0, 1, 7, 8, 9], [-100, -100, 7, 8, 9]), ([1, 2, 3], [-100, -100, 3])]
    assert rejected.count() == 1


def test_folder_job(spark, tmp_path):
    import json

    from scenegrade.plans.evaluate import score_folders
    from tests.test_documents import base

    gold, results = tmp_path / "gold", tmp_path / "results"
    for folder in (gold, results):
        folder.mkdir()
    (gold / "a.json").write_text(json.dumps(base()))
    (results / "question_a_m-1.json").write_text(json.dumps(base()))
    (results / "question_a_m2.json").write_bytes(b"\xff")
    scores, summary = score_folders(spark, str(gold), str(results))
    assert {(r.model, r.parse_ok) for r in scores.collect()} == {("m-1", True), ("m2", False)}
    assert summary.filter("model = 'm-1'").first().global_slot_macro_acc_mean == 1.0


def test_labels_keep_their_text(spark):
    from scenegrade.operators.trainset import label_texts

    texts = ['{ "b": 1.0,\n "a": [2e0, " x : \\" ,y "] }', '"plain"', "{bad"]
    kept, rejects = label_texts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r["label"] for r in kept.collect()} == {'{"b":1.0,"a":[2e0," x : \\" ,y "]}', "plain"}
    assert rejects.count() == 1


def test_first_videos_in_file_name_order(spark):
    from scenegrade.plans.leaderboard import first_videos

    gold = spark.createDataFrame([("cam_4",), ("cam_4-b",)], "video_id string")
    assert first_videos(gold, 1).first()[0] == "cam_4-b"


def test_roots_in_any_spelling(spark, tmp_path):
    from scenegrade.sources.files import media_files

    (tmp_path / "v/a").mkdir(parents=True)
    (tmp_path / "v/a/x.mp4").write_bytes(b"x")
    for root in (f"{tmp_path}/v", f"{tmp_path}/v/", f"file:{tmp_path}/v", f"file://{tmp_path}/v"):
        assert [r["rel_path"] for r in media_files(spark, root).collect()] == ["a/x.mp4"], root
