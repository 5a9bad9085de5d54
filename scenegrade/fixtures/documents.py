"""Assessment documents derived from the order and line tables (see ``rules``)."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from scenegrade.fixtures import rules as R
from scenegrade.functions.json_docs import computed_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _join(parts):
    return f"concat_ws(',', {', '.join(parts)})"


def _key(name, text):
    return f"concat('\"{name}\":', {text})"


def _obj(*parts):
    return f"concat('{{', {_join(parts)}, '}}')"


def _quoted(text):
    return f"concat('\"', {text}, '\"')"


def _lookup(index, texts):
    """Text at a place of a constant list; NULL for a place that is NULL, negative or beyond it.

    The list is one constant of the plan. A CASE over the places, which says the same, repeats the index in every branch,
    and so many branches are neither compiled nor, in the lambdas over the lines, evaluated in reasonable time.
    """
    return f"get(split('{'|'.join(texts)}', '[|]'), CAST({index} AS INT))"


def _picked(name, index, domain):
    """Member ``name`` whose value is domain[index % n], as ``R.pick`` says."""
    return _lookup(f"({index}) % {len(domain)}", [f'"{name}":"{v}"' for v in domain])


def _numbered(index, n, before, after):
    """``before``, index % n, ``after``; of negative keys the remainders are negative too."""
    return _lookup(f"({index}) % {n} + {n - 1}", [f"{before}{i}{after}" for i in range(1 - n, n)])


# what R.hundredths spells for the remainders -99 to 99, and behind them a number that is no confidence
_HUNDREDTHS = ["0." + str(i).rjust(2, "0")[:2] for i in range(-99, 100)]


def _hundredths(x, before="", after=""):
    return _lookup(f"({x}) % 100 + 99", [before + text + after for text in _HUNDREDTHS])


def _hundredths_or(bad, text, x):
    """Member ``confidence``: hundredths of x, or ``text`` if it is bad."""
    texts = [f'"confidence":{t}' for t in [*_HUNDREDTHS, text]]
    return _lookup(f"CASE WHEN {bad} THEN {len(_HUNDREDTHS)} ELSE ({x}) % 100 + 99 END", texts)


def _visible(f):
    return (
        f"CASE WHEN {R.visible_missing(f)} THEN NULL WHEN {R.visible(f)} THEN '\"visible\":true' "
        "ELSE '\"visible\":false' END"
    )


def _value_member(field):
    f = field.f
    if field.kind == "enum":
        return _picked("value", R.moved(f), field.domain)
    if field.kind == "bool":
        words = f"CASE WHEN {R.bool_value(f)} THEN '\"value\":true' ELSE '\"value\":false' END"
        digits = f"CASE WHEN {R.bool_value(f)} THEN '\"value\":1' ELSE '\"value\":0' END"
        return f"CASE WHEN {R.bool_as_number(f)} THEN {digits} ELSE {words} END"
    if field.kind == "tri":
        known = _lookup(f"{R.moved(f)} % 4", [f'"value":{word}' for word in R.TRI_WORDS])
        return f"coalesce({known}, '\"value\":\"unknown\"')"
    unknown, value = (
        (R.LANES_UNKNOWN, R.LANES_VALUE) if field.kind == "lanes" else (R.speed_unknown(f), R.speed_value(f))
    )
    return f"CASE WHEN {unknown} THEN '\"value\":\"unknown\"' ELSE {_key('value', f'CAST({value} AS STRING)')} END"


def _value(field):
    return f"CASE WHEN {R.value_missing(field.f)} THEN NULL ELSE {_value_member(field)} END"


def _confidence(f):
    bare = [*_HUNDREDTHS, "1.5"]
    place = f"CASE WHEN {R.confidence_bad(f)} THEN {len(_HUNDREDTHS)} ELSE ({R.confidence_hundredths(f)}) % 100 + 99 END"
    quoted = f"CASE WHEN {R.confidence_as_string(f)} THEN {len(bare)} ELSE 0 END"
    text = _lookup(f"({place} + {quoted})", bare + [f'"{t}"' for t in bare])
    return f"CASE WHEN {R.confidence_missing(f)} THEN NULL ELSE {_key('confidence', text)} END"


def _leaf_object(field, *extra):
    parts = [_visible(field.f)] if field.shape == "VVC" else []
    return _obj(*parts, _value(field), _confidence(field.f), *extra)


def _road():
    parts = []
    for field in (x for x in R.FIELDS if x.section == "road"):
        if field.shape == "VVC":
            parts.append(_key(field.path, _leaf_object(field)))
        elif field.shape == "V":
            inner = [_visible(field.f)] + [
                _key(x.path.split(".")[1], _leaf_object(x))
                for x in R.FIELDS
                if x.section == "road" and x.shape == "VC" and x.visible_by == field.f
            ]
            parts.append(_key(field.path, _obj(*inner)))
    return _obj(*parts)


def _environment():
    good = _obj(*[_key(x.path, _leaf_object(x)) for x in R.FIELDS if x.section == "env"])
    return f"CASE WHEN {R.BAD_ENVIRONMENT} THEN '\"n/a\"' ELSE {good} END"


def _per_line(text, dropped):
    """JSON list over the lines of the order; line columns become lambda fields."""
    body = f"CASE WHEN {dropped} THEN NULL ELSE {text} END"
    body = re.sub(r"(?<![\w'])([psnq])(?![\w'(])", r"x.\1", body)
    return f"concat('[', concat_ws(',', array_compact(transform(lines, x -> {body}))), ']')"


def _or_wrong(name, wrong, text, index, domain):
    """Member ``name`` with domain[index % n], or ``text`` where it is wrong."""
    place = f"CASE WHEN {wrong} THEN {len(domain)} ELSE ({index}) % {len(domain)} END"
    return _lookup(place, [f'"{name}":"{v}"' for v in [*domain, text]])


def _lanes():
    def part(missing, value, hundredths):
        shown = f"CASE WHEN {missing} THEN NULL ELSE {value} END"
        return _obj(shown, _hundredths(hundredths, '"confidence":'))

    lane_id = f"CASE WHEN {R.LANE_ID_AS_STRING} THEN {_quoted('CAST(n AS STRING)')} ELSE CAST(n AS STRING) END"
    status = _picked("value", R.LANE_STATUS_AT, R.S.LANE_ENUMS["status"])
    density = _or_wrong("value", R.LANE_DENSITY_WRONG, "packed", R.LANE_DENSITY_AT, R.S.LANE_ENUMS["vehicle_density"])
    item = _obj(
        _key("lane_id", lane_id),
        _key("status", part(R.LANE_STATUS_MISSING, status, R.LANE_STATUS_HUNDREDTHS)),
        _key("vehicle_density", part(R.LANE_DENSITY_MISSING, density, R.LANE_DENSITY_HUNDREDTHS)),
    )
    return (
        f"CASE WHEN {R.TRAFFIC_OBJECT} THEN '{{}}' WHEN {R.TRAFFIC_STRING} THEN '\"none\"' "
        f"WHEN {R.TRAFFIC_NULL} THEN 'null' ELSE {_per_line(item, R.LANE_DROPPED)} END"
    )


def _vehicle_events():
    count = (
        f"CASE WHEN {R.VEHICLE_COUNT_AS_STRING} THEN {_quoted(f'CAST({R.VEHICLE_COUNT} AS STRING)')} "
        f"ELSE CAST({R.VEHICLE_COUNT} AS STRING) END"
    )
    enums = R.S.VEHICLE_EVENT_ENUMS
    event_type = _picked("event_type", R.VEHICLE_EVENT_TYPE_AT, enums["event_type"])
    confidence = _hundredths_or(R.VEHICLE_CONFIDENCE_BAD, "1.5", R.VEHICLE_HUNDREDTHS)
    item = _obj(
        f"CASE WHEN {R.VEHICLE_TYPE_AS_NUMBER} THEN '\"event_type\":7' ELSE {event_type} END",
        _numbered("p + m", 3, '"description":"case ', '"'),
        _picked("involved_vehicle_type", R.VEHICLE_INVOLVED_AT, enums["involved_vehicle_type"]),
        _picked("risk_level", R.VEHICLE_RISK_AT, R.S.RISK_LEVELS),
        f"CASE WHEN {R.VEHICLE_CONFIDENCE_MISSING} THEN NULL ELSE {confidence} END",
        _key("count", count),
    )
    return _per_line(item, R.VEHICLE_DROPPED)


def _pedestrian_events():
    enums, interaction = R.S.PEDESTRIAN_EVENT_ENUMS, "interaction_with_vehicles"
    confidence = _hundredths_or(R.PEDESTRIAN_CONFIDENCE_BAD, "2.5", R.PEDESTRIAN_HUNDREDTHS)
    item = _obj(
        _picked("behavior", R.PEDESTRIAN_BEHAVIOR_AT, enums["behavior"]),
        _picked("location", R.PEDESTRIAN_LOCATION_AT, enums["location"]),
        _or_wrong(interaction, R.PEDESTRIAN_INTERACTION_WRONG, "odd", R.PEDESTRIAN_INTERACTION_AT, enums[interaction]),
        _picked("risk_level", R.PEDESTRIAN_RISK_AT, R.S.RISK_LEVELS),
        f"CASE WHEN {R.PEDESTRIAN_CONFIDENCE_MISSING} THEN NULL ELSE {confidence} END",
        _key("count", f"CAST({R.PEDESTRIAN_COUNT} AS STRING)"),
    )
    return _per_line(item, R.PEDESTRIAN_DROPPED)


def _observation(field):
    f = field.f
    if field.path in R.S.PAIR_OBSERVATIONS:
        first = _numbered("k", 7, '{"leader_id":"v', '",')
        pair = f"concat({first}, {_numbered(R.second_number(f), 5, '"follower_id":"v', '"}')})"
        bad = f"CASE WHEN {R.MALFORMED_PAIR} THEN '{{\"leader_id\":5}}' END"
        body = f"CASE WHEN {R.no_ids(f)} THEN '[]' ELSE concat('[', {_join([pair, bad])}, ']') END"
        return _leaf_object(field, _key("pairs", body))
    first, second = _numbered("k", 7, '["v', '",'), _numbered(R.second_number(f), 5, '"v', '"]')
    ids = f"concat({first}, {second})"
    return _leaf_object(field, _key("vehicle_ids", f"CASE WHEN {R.no_ids(f)} THEN '[]' ELSE {ids} END"))


def _risk():
    observations = [_key(x.path, _observation(x)) for x in R.FIELDS if x.section == "obs"]
    custom = (
        f"CASE WHEN {R.CUSTOM_OBSERVATION} THEN concat('\"', {R.CUSTOM_NAME}, "
        f"'\":{{\"visible\":true,\"value\":true,\"confidence\":0.5,\"vehicle_ids\":[\"', {R.CUSTOM_ID}, '\"]}}') END"
    )
    shown = f"CASE WHEN {R.LIST_OBSERVATIONS} THEN '[]' ELSE {_obj(*observations, custom)} END"
    factors = (
        f"concat({_numbered('k', 4, '["f', '",')}, {_numbered(R.FACTOR_2_NUMBER, 5, '"f', '"')}, "
        f"CASE WHEN {R.NUMBER_FACTOR} THEN ',3' ELSE '' END, ']')"
    )
    overall = _obj(_key("risk_level", _leaf_object(R.RISK_FIELD)), _key("main_risk_factors", factors))
    body = _obj(_key("observations", shown), _key("overall_risk_assessment", overall))
    return f"CASE WHEN {R.NO_RISK} THEN '[]' ELSE concat('[', {body}, ']') END"


def _text():
    """JSON text of document (k, m), built from columns k, m, n_lines and lines."""
    pedestrians = _key("pedestrian_events", _pedestrian_events())
    full = _obj(
        _key("road_composition", _road()),
        _key("environmental_conditions", _environment()),
        _key("traffic_status", _lanes()),
        _key("vehicle_events", _vehicle_events()),
        f"CASE WHEN {R.NO_PEDESTRIANS} THEN NULL ELSE {pedestrians} END",
        _key("Risk Assessment", _risk()),
    )
    return f"CASE WHEN {R.ERROR_DOC} THEN '{{\"error\":\"generation failed\"}}' ELSE {full} END"


def spread_partitions(spark):
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))


def _versions(base, versions):
    return base.withColumn("m", F.explode(F.array(*[F.lit(v).cast("bigint") for v in versions])))


def _video_id():
    return F.concat(F.lit("clip_"), F.col("k").cast("string")).alias("video_id")


def _documents(spark, sf_dir, versions) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("l_linenumber").cast("bigint").alias("n"),
                        F.col("l_partkey").alias("p"),
                        F.col("l_suppkey").alias("s"),
                        F.col("l_extendedprice").alias("e"),
                        F.col("l_quantity").cast("bigint").alias("q"),
                    )
                )
            ).alias("lines")
        )
    )
    base = (
        _orders(spark, sf_dir).join(lines, "k", "left")
        .withColumn("lines", F.coalesce("lines", F.expr("cast(array() as array<struct<n:bigint,p:bigint,s:bigint,e:double,q:bigint>>)")))
        .withColumn("n_lines", F.size("lines"))
        .repartition(spread_partitions(spark), "k")  # few input bytes, much text: do not coalesce
    )
    return computed_once(_versions(base, versions), "full", F.expr(_text())).select(
        "k",
        "m",
        _video_id(),
        F.expr(
            f"CASE WHEN {R.CUT} OR {R.GOLD_CUT} THEN left(full, 20) WHEN {R.WRAPPED} THEN concat('[', full, ']') "
            f"WHEN {R.TRAILING} THEN concat(full, ' trailing') ELSE full END"
        ).alias("text"),
    )


def gold_texts(spark, sf_dir) -> DataFrame:
    """``video_id, text``: one gold document per order."""
    return _documents(spark, sf_dir, [0]).select("video_id", "text")


def student_texts(spark, sf_dir) -> DataFrame:
    """``video_id, model, text``: one document per order and model."""
    names = F.expr("CASE m " + " ".join(f"WHEN {m} THEN '{name}'" for m, name in R.MODELS.items()) + " END")
    return _documents(spark, sf_dir, list(R.MODELS)).select("video_id", names.alias("model"), "text")


def run_texts(spark, sf_dir) -> DataFrame:
    """``stem, run, file_name, text``: five noisy runs per order."""
    return _run_names(_documents(spark, sf_dir, R.RUNS), "text")


def run_names(spark, sf_dir) -> DataFrame:
    """``stem, run, file_name`` of ``run_texts``, without making a text."""
    orders = _orders(spark, sf_dir).repartition(spread_partitions(spark), "k")  # few input bytes, many names
    return _run_names(_versions(orders, R.RUNS).select("m", _video_id()))


def _run_names(versions, *more):
    return versions.select(
        F.col("video_id").alias("stem"),
        F.col("m").cast("int").alias("run"),
        F.concat("video_id", F.lit(".teacher.perception_raw.run_"), F.col("m").cast("string"), F.lit(".json")).alias(
            "file_name"
        ),
        *more,
    )
