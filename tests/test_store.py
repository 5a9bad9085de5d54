"""The document store: parsed once, flags and leaves read alone, jobs over it equal to jobs over texts."""

import json

import pytest
from pyspark.sql import functions as F

from scenegrade.fixtures import documents as D
from scenegrade.functions import json_docs as J
from scenegrade.operators import consensus as C
from scenegrade.operators.validate import with_validation
from scenegrade.plans import gold as G
from scenegrade.plans.evaluate import integrate_folder, score_tables
from scenegrade.sources import store

SF = "/root/testdata/sf0.001"
ODD = ['{"a":1}', '{"a":1.0}', '{"a":"1"}', '{"a":1} x', "[1]", "", None, '{"a":{"b":[1,{"c":null}]}}', '{"a":1,"a":2}', '{"a":12345678901234567890}', '{"a":1e300}', '{"é":"\\u00e9\\n"}', "{"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_documents_equal_parsed_ones(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(ODD)), "k int, text string")
    parsed = J.parse_documents(docs)
    stored = store.write_documents(docs, f"{tmp_path}/odd")
    assert stored.columns == ["k", "json_ok", "parse_ok", "obj"]
    view = lambda df: sorted(map(str, df.select("k", "json_ok", "parse_ok", F.to_json("obj").alias("j"), J.canon(J.leaf("obj", "a")).alias("c"), J.is_integer(J.sub("obj", "a")).alias("i")).collect()))
    assert view(stored) == view(parsed)
    store.write_documents(docs, f"{tmp_path}/odd", mode="append")
    assert store.read_documents(spark, f"{tmp_path}/odd").count() == 2 * len(ODD)
    again = store.write_documents(stored, f"{tmp_path}/again")  # a store can be stored
    assert view(again.limit(len(ODD))) == view(parsed)
    empty = store.write_documents(docs.limit(0), f"{tmp_path}/empty")
    assert empty.count() == 0 and store.stored_or_none(spark, f"{tmp_path}/none") is None


def test_jobs_over_the_store_parse_nothing_and_read_leaves(spark, tmp_path):
    students = store.write_documents(D.student_texts(spark, SF).limit(200), f"{tmp_path}/students")
    one = students.select(J.leaf("obj", "environmental_conditions.weather.value").alias("w"))
    assert "parse_json" not in plan(one).lower()
    assert "ReadSchema: struct<obj:struct<0:variant>>" in plan(one)  # a single pushed leaf
    flags = students.filter("parse_ok").select("video_id")
    assert "obj" not in plan(flags).split("ReadSchema")[1]
    checked = with_validation(students).select("video_id", "errors")
    assert "parse_json" not in plan(checked).lower() and "ReadSchema: struct<video_id:string,parse_ok:boolean,obj:struct<0:" in plan(checked)


def test_scores_of_stores_equal_scores_of_texts(spark, tmp_path):
    gold, students = D.gold_texts(spark, SF), D.student_texts(spark, SF)
    files = students.selectExpr("concat('/r/', video_id, '_', model, '.json') AS path", "concat(video_id, '_', model, '.json') AS file_name", "text")
    runs = D.run_texts(spark, SF).select("file_name", "text")
    documents = gold.selectExpr("video_id AS stem", "text AS document")
    _, want = score_tables(documents, files, runs)
    stores = [store.write_documents(gold, f"{tmp_path}/gold"), store.write_documents(files, f"{tmp_path}/files"), store.write_runs(runs, f"{tmp_path}/runs")]
    _, found = score_tables(*stores)
    assert "parse_json" not in plan(found).lower()
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rounded(found) == rounded(want) and found.count() == 4


def test_gold_documents_from_the_run_store(spark, tmp_path):
    runs = D.run_texts(spark, SF).select("file_name", "text")
    want = G.gold_documents(C.with_validity(J.parse_documents(C.gather_runs(runs))), 4)
    stored = store.write_runs(runs, f"{tmp_path}/runs")
    found = G.gold_documents(stored, 4)
    assert "parse_json" not in plan(found).lower()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_integrate_folder_keeps_its_run_store(spark, tmp_path):
    for k, text in enumerate(['{"vehicle_events":[]}', "[1]", '{"error":"x"}'], 1):
        (tmp_path / f"a.teacher.perception_raw.run_{k}.json").write_text(text)
    done = integrate_folder(spark, str(tmp_path), 2, store=f"{tmp_path}/store").collect()
    assert [r["status"] for r in done] == ["insufficient_valid_runs"]
    assert [x["error"] for x in json.loads(done[0]["document"])["invalid"]] == ["error_payload_or_not_object"] * 2
    kept = store.read_documents(spark, f"{tmp_path}/store")
    assert {(r["run"], r["valid"]) for r in kept.collect()} == {(1, True), (2, False), (3, False)}


def test_without_a_shared_folder_there_is_a_clear_error(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before:
        assert store.shared_path(spark, "x").startswith(before.rstrip("/"))
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_path(spark, "x")
