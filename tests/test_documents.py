"""Hand-derived edge cases of parsing, scoring and validation."""

import json

import pytest
from pyspark.sql import functions as F

from scenegrade.functions import json_docs as J
from scenegrade.operators.score import score_pairs
from scenegrade.operators.validate import with_validation


def lane(i, status="free", density="low"):
    return {"lane_id": i, "status": {"value": status, "confidence": 0.5},
            "vehicle_density": {"value": density, "confidence": 0.5}}


def event(count=1, kind="other", risk="low"):
    return {"event_type": kind, "involved_vehicle_type": "car", "risk_level": risk, "confidence": 0.5, "count": count}


def base(**changes):
    doc = {
        "road_composition": {"number_of_lanes": {"visible": True, "value": 1, "confidence": 0.5}},
        "environmental_conditions": {}, "traffic_status": [lane(1)], "vehicle_events": [],
        "pedestrian_events": [], "Risk Assessment": [{"observations": {}, "overall_risk_assessment": {}}],
    }
    doc.update(changes)
    return doc


def score(spark, gold, student):
    text = lambda d: d if isinstance(d, str) else json.dumps(d)
    g = J.parse_documents(spark.createDataFrame([("v", text(gold))], "video_id string, text string"))
    s = J.parse_documents(spark.createDataFrame([("v", "m", text(student))], "video_id string, model string, text string"))
    return score_pairs(g, s).first()


@pytest.mark.parametrize(
    "text,ok",
    [('{"a":1}', True), (' {"a":1}\n', True), ('{"a":1}x', False), ('{"a":1}] z', False), ('{"a":1},{"b":2}', False),
     ('{"a":1}} z', False), ("[1]", False), ("1", False), ("", False), (None, False), ("﻿{}", False), ('{"a":1,"a":2}', True)],
)
def test_strict_parse(spark, text, ok):
    row = J.parse_documents(spark.createDataFrame([(text,)], "text string")).first()
    assert row.parse_ok is ok


def test_identical_documents_score_one(spark):
    row = score(spark, base(), base())
    assert row.global_slot_macro_acc == 1.0 and row.traffic_status_macro_acc == 1.0
    assert row.overall_risk_level_acc == 1.0 and row.main_risk_factors_f1 == 1.0
    assert row.risk_vehicle_ids_f1 == 0.0 and row.risk_pairs_f1 == 0.0


def test_leaf_equality_and_gates(spark):
    def crossing(visible, present):
        return base(road_composition={"pedestrian_crossings": {"visible": visible, "present": {"value": present}}})

    # 20 road slots: 7 visible leaves, all None = None but one; present opens with visible true
    assert score(spark, crossing(True, True), crossing(True, 1)).road_composition_slot_macro_acc == 1.0
    # gold visible 1 equals student true but opens no gate: 7 slots only
    assert score(spark, crossing(1, True), crossing(True, False)).road_composition_slot_macro_acc == 1.0
    wrong = score(spark, crossing(True, True), crossing(True, "true")).road_composition_slot_macro_acc
    assert wrong == pytest.approx(8 / 9)


def test_traffic_cases(spark):
    missing = base()
    del missing["traffic_status"]
    assert score(spark, base(traffic_status=None), missing).traffic_status_macro_acc == 1.0
    assert score(spark, base(traffic_status={}), base()).traffic_status_macro_acc == 0.0
    # the last entry of lane 1 counts, the length counts both
    gold = base(traffic_status=[lane(1, "slow"), lane(1, "free")])
    row = score(spark, gold, base(traffic_status=[lane(1, "free")]))
    assert row.traffic_length_acc == 0.0 and row.traffic_per_lane_macro_acc == 1.0
    # absent lane: unknown gold status is still a hit
    row = score(spark, base(traffic_status=[lane(1, None)]), base(traffic_status=[]))
    assert row.traffic_per_lane_macro_acc == pytest.approx(1 / 3)


def test_event_cases(spark):
    row = score(spark, base(), base(vehicle_events=[event()]))
    assert (row.vehicle_presence_f1, row.vehicle_count_acc, row.vehicle_events_macro_acc) == (0.0, 1.0, 0.5)
    assert score(spark, base(vehicle_events=[event(0)]), base()).vehicle_count_acc == 1.0
    assert score(spark, base(vehicle_events=[event(3)]), base(vehicle_events=[event(1), event(2)])).vehicle_count_acc == 1.0
    assert score(spark, base(vehicle_events=[event(2)]), base(vehicle_events=[event("2")])).vehicle_count_acc == 0.0


def test_absent_risk_scores_zero(spark):
    row = score(spark, base(), base(**{"Risk Assessment": []}))
    assert row.risk_obs_macro_acc == 0.0 and row.overall_risk_level_acc == 0.0


def test_unparsed_student_has_no_metrics(spark):
    assert score(spark, base(), "{").global_slot_macro_acc is None


def validate(spark, doc):
    docs = J.parse_documents(spark.createDataFrame([(json.dumps(doc),)], "text string"))
    return with_validation(docs).first()


def test_validation_messages(spark):
    doc = base(road_composition={"number_of_lanes": {"visible": True, "value": True, "confidence": "0.5"},
                                 "lane_directions": {"confidence": 1.2}})
    row = validate(spark, doc)
    assert "rule_lane:number_of_lanes.value_bad=True" in row.errors
    assert not any("len_mismatch" in e for e in row.errors)
    assert "bad_conf:road_composition.lane_directions.confidence=1.2" in row.errors
    assert not any(e.endswith("number_of_lanes.confidence") for e in row.errors)
    assert row.errors.count("missing_conf:traffic_status[0].status.confidence") == 1
    assert not row.rule_ok and not row.schema_ok
    row = validate(spark, base(traffic_status="x"))
    assert "traffic_status_not_null_or_list" in row.errors
    assert "rule_lane:traffic_status_len_mismatch expected=1 got=-1" in row.errors


def test_numbers_are_equal_as_in_python(spark):
    texts = ["9007199254740993", "9007199254740992", "2", "2.0", "-0", "0", "1.0E7", "10000000", "0.5", "true", "1"]
    rows = spark.createDataFrame([(x,) for x in texts], "j string").select("j", J.canon(F.col("j")).alias("c")).collect()
    key = {r.j: r.c for r in rows}
    values = {x: json.loads(x) for x in texts}
    for a in texts:
        for b in texts:
            assert (key[a] == key[b]) == (values[a] == values[b]), (a, b)
