"""Texts of the document fixtures, made with constant lists, and flags of runs read without their objects."""

import json

import pytest
from pyspark.sql import functions as F

from scenegrade.fixtures import documents as D
from scenegrade.fixtures import rules as R
from scenegrade.functions import json_docs as J
from scenegrade.operators import consensus as C

DOMAIN = ["car", "truck", "bus"]
MADE = {  # what the documents spell with a list, and the rule it must agree with
    "picked": (D._picked("value", "k + m", DOMAIN), f"concat('\"value\":\"', {R.pick('k + m', DOMAIN)}, '\"')"),
    "numbered": (D._numbered("k", 7, '["v', '",'), f"concat('[\"', {R.FIRST_ID}, '\",')"),
    "hundredths": (D._hundredths("k * 3 + m", "c:"), f"concat('c:', {R.hundredths('k * 3 + m')})"),
    "or_text": (
        D._hundredths_or("(k + m) % 9 = 0", "2.5", "k + m"),
        f"concat('\"confidence\":', CASE WHEN (k + m) % 9 = 0 THEN '2.5' ELSE {R.hundredths('k + m')} END)",
    ),
    "or_wrong": (
        D._or_wrong("kind", "(k + m) % 8 = 0", "odd", "k", DOMAIN),
        f"concat('\"kind\":\"', CASE WHEN (k + m) % 8 = 0 THEN 'odd' ELSE {R.pick('k', DOMAIN)} END, '\"')",
    ),
    "tri": (
        D._value_member(R.BY_PATH["obs", "crossed_intersection"]),
        f"concat('\"value\":', CASE {R.tri_value(R.BY_PATH['obs', 'crossed_intersection'].f)} WHEN 'unknown' THEN '\"unknown\"'"
        " WHEN 'true' THEN 'true' ELSE 'false' END)",
    ),
    "confidence": (
        D._confidence(3),
        f"CASE WHEN {R.confidence_missing(3)} THEN NULL ELSE concat('\"confidence\":', CASE WHEN {R.confidence_as_string(3)}"
        f" THEN concat('\"', {R.confidence(3)}, '\"') ELSE {R.confidence(3)} END) END",
    ),
}


@pytest.mark.parametrize("name", list(MADE))
def test_lists_spell_what_the_rules_say(spark, name):
    made, ruled = MADE[name]
    keys = spark.range(-230, 231).select(F.col("id").alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    rows = keys.crossJoin(spark.range(0, 6).withColumnRenamed("id", "m")).selectExpr("k", "m", f"{made} AS made", f"{ruled} AS ruled")
    assert rows.filter("NOT made <=> ruled").take(3) == []
    assert rows.filter("made IS NOT NULL").count() > 100


def test_a_text_repeats_no_index_in_branches():
    """The domains were spelled as a CASE that repeats its index at every place."""
    assert D._text().count("WHEN 3 THEN") == 0


def test_validity_of_runs_needs_no_object(spark):
    texts = [
        json.dumps({"road_composition": {}}), json.dumps({"error": "x"}), json.dumps({"error": None}), " \n{} ", "[{}]",
        json.dumps({"error": 1, "road_composition": None}), '{"a": 1} x', '{"error": 1', '[{"error": 1}]', "{}, {}", None, "",
    ]
    names = [f"v.teacher.perception_raw.run_{i}.json" for i in range(len(texts))]
    files = C.gather_runs(spark.createDataFrame(list(zip(names, texts)), "file_name string, text string"))
    lean = C.with_validity(J.parse_documents(files, present=C.VALIDITY_KEYS))
    full = C.with_validity(J.parse_documents(files))
    assert lean.columns == full.columns
    shown = [[tuple(r) for r in x.select("run", "valid", "reject_reason", "parse_ok").orderBy("run").collect()] for x in (lean, full)]
    assert shown[0] == shown[1]
    assert [r[0] for r in shown[0] if r[1]] == [0, 3, 5]
    plan = C.run_gate(lean)._jdf.queryExecution().optimizedPlan().toString()
    assert "$[0], VariantType" not in plan and "$[0].error" in plan


def test_names_of_runs_tell_how_positions_are_packed_without_a_text(spark):
    names = [f"a.teacher.perception_raw.run_{n}.json" for n in ("1", "02", "3")]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    unread = files.withColumn("text", F.concat("file_name", F.raise_error(F.lit("a text was made"))))
    runs = C.with_validity(J.parse_documents(C.gather_runs(unread)))
    assert dict(C.consensus(runs, ["risk"], names=files).dtypes)["members"] == "array<string>"  # no text was made for it
    long_number = files.unionByName(spark.sql("SELECT 'a.teacher.perception_raw.run_1234567890.json' AS file_name"))
    assert C.packs(C.gather_runs(files)) and not C.packs(C.gather_runs(long_number))

    risk = '{"road_composition":{},"Risk Assessment":[{"overall_risk_assessment":{"main_risk_factors":["%s"]}}]}'
    texts = long_number.withColumn("text", F.format_string(risk, F.col("file_name").substr(30, 2)))
    runs = C.with_validity(J.parse_documents(C.gather_runs(texts)))
    named, read = C.consensus(runs, ["risk"], names=long_number), C.consensus(runs, ["risk"])
    assert [row.members for row in named.collect()] == [row.members for row in read.collect()] == [["1.", "02", "3.", "12"]]


def test_run_names_are_those_of_the_texts(spark, tmp_path):
    lines = "k AS l_orderkey, n AS l_linenumber, 7L AS l_partkey, 5L AS l_suppkey, 1.5D AS l_extendedprice, 2D AS l_quantity"
    spark.sql("SELECT col1 AS o_orderkey FROM VALUES (1L), (1L), (2L), (NULL)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(f"SELECT {lines} FROM VALUES (1L, 1), (1L, 2), (NULL, 1) AS t(k, n)").write.parquet(f"{tmp_path}/lineitem.parquet")
    columns = ["stem", "run", "file_name"]
    found = [sorted(map(str, f(spark, str(tmp_path)).select(columns).collect())) for f in (D.run_names, D.run_texts)]
    assert found[0] == found[1] and len(found[0]) == 20
