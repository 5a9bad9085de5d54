"""Per-document features: everything scoring needs, extracted once per document.

A gold document meets the output of every model, so leaves are read before the
join and scoring works on small string arrays. Facts become tokens such that a
hit between two documents is a shared token:

* slots: ``<index>=<canonical value>``, with ``~`` for absent or null. ``*_gated``
  holds the tokens that count when the document is the gold side.
* lanes and event sums: a token per known fact. "Both unknown" (or "missing
  counts as 0") is a hit too, so the complementary sets are kept as well and
  matched with ``array_except``.
"""

from pyspark.sql import Column, DataFrame, functions as F

from scenegrade.functions import json_docs as J
from scenegrade.functions import schema as S
from scenegrade.operators.leaves import at, fixed, shape, with_leaves, without_leaves

SCORE_COLUMNS = [
    "road", "env", "ts_kind", "ts_len", "lane_facts", "lane_known",
    "veh_keys", "veh_sums", "veh_nonzero", "ped_keys", "ped_sums", "ped_nonzero",
    "risk_ok", "obs", "obs_ids", "obs_pairs", "risk_level", "risk_factors",
]
GOLD_COLUMNS = [
    "road_gated", "env_gated", "ts_kind", "ts_len", "lane_facts", "lane_unknown", "n_lanes",
    "veh_keys", "veh_sums", "veh_zero", "ped_keys", "ped_sums", "ped_zero",
    "risk_ok", "obs_gated", "obs_ids", "obs_true", "obs_pairs", "pairs_true", "risk_level", "risk_factors",
]


def first_risk(obj="obj") -> Column:
    """First element of the risk list, if there is one."""
    return F.try_variant_get(J.col(obj), "$['Risk Assessment'][0]", "variant")


def present(texts: list) -> Column:
    """Array of those texts that are not NULL, none of which is empty; compiled, as ``array_compact`` is not."""
    return F.array_remove(F.array(*[F.coalesce(text, F.lit("")) for text in texts]), "")


def _slot_columns(df: DataFrame, name: str, leaf, slots) -> DataFrame:
    """Add ``name`` (all tokens) and ``name_gated`` (tokens scored when gold); ``leaf`` gives the text at a path.

    The gated tokens are picked without a lambda: Catalyst would move the gates, which it sees used once, into it and
    judge all gates of a document again for every token.
    """
    index = {slot.path: i for i, slot in enumerate(slots)}
    raw = F.col(f"_raw_{name}")

    def gate(slot):
        ok = F.lit(True)
        for path in slot.gates:
            ok = ok & F.coalesce(raw[index[path]] == "true", F.lit(False))
        return ok

    return (
        df.withColumn(f"_raw_{name}", F.array(*[leaf(slot.path) for slot in slots]))
        .withColumn(
            name,
            F.transform(raw, lambda x, i: F.concat(i.cast("string"), F.lit("="), F.coalesce(J.canon(x), F.lit("~")))),
        )
        .withColumn(f"{name}_gated", present([F.when(gate(slot), F.col(name)[i]) for i, slot in enumerate(slots)]))
        .drop(f"_raw_{name}")
    )


def _lane_columns(df: DataFrame) -> DataFrame:
    """Facts of the lanes with an integer id; of several with the same id the last one counts.

    Lanes are sorted by id and place, so the last of an id is the one before another id.
    """
    lanes = F.col("_lanes")

    def placed(x, i):
        return F.struct(x.n.alias("n"), i.alias("i"), x.n.cast("string").alias("id"), J.canon(x.s).alias("s"), J.canon(x.d).alias("d"))

    def per_lane(fn):
        return F.coalesce(F.flatten(F.transform(lanes, fn)), F.array().cast("array<string>"))

    def fact(x, part):
        return F.concat(x.id, F.lit(f":{part}="), x[part])

    def place(x, part, known):
        return F.when(x[part].isNotNull() if known else x[part].isNull(), F.concat(x.id, F.lit(f":{part}")))

    def is_last(x, i):
        following = F.get("_by_id", i + 1)
        return following.isNull() | (following.n != x.n)

    return (
        df.withColumn("ts_len", F.when(F.col("_ts").isNotNull(), F.size("_ts")))
        .withColumn(
            "ts_kind",
            F.when(F.col("_ts").isNotNull(), "list").when(F.col("_ts_null"), "null").otherwise("other"),
        )
        .withColumn("_by_id", F.sort_array(F.filter(F.transform("_ts", placed), lambda x: x.n.isNotNull())))
        .withColumn("_lanes", F.filter("_by_id", is_last))
        .withColumn("n_lanes", F.coalesce(F.size("_lanes"), F.lit(0)))
        .withColumn("lane_facts", F.array_compact(per_lane(lambda x: F.array(x.id, fact(x, "s"), fact(x, "d")))))
        .withColumn(
            "lane_known", F.array_compact(per_lane(lambda x: F.array(place(x, "s", True), place(x, "d", True))))
        )
        .withColumn(
            "lane_unknown", F.array_compact(per_lane(lambda x: F.array(place(x, "s", False), place(x, "d", False))))
        )
        .drop("_by_id", "_lanes")
    )


def _event_columns(df: DataFrame, name: str, events: str, key_fields) -> DataFrame:
    """Bag of events: distinct keys, and the summed count per key.

    Events are sorted by key, so the events of a key are a run, which is summed on its own.
    """

    def key(x):
        all_strings = F.lit(True)
        for field in key_fields:
            all_strings = all_strings & J.is_string(x[field])
        return F.when(all_strings, F.concat_ws(",", *[x[field] for field in key_fields]))

    keyed = F.transform(events, lambda x: F.struct(key(x).alias("k"), F.coalesce(x.n, F.lit(0)).alias("c")))
    bag, heads, sums = F.col("_bag"), F.col("_heads"), F.col("_sums")

    def run(head, j):
        size = F.coalesce(F.get(heads, j + 1), F.size(bag)) - head
        total = F.aggregate(F.slice(bag, head + 1, size), F.lit(0).cast("bigint"), lambda acc, x: acc + x.c)
        return F.struct(bag[head].k.alias("k"), total.alias("n"))

    def keys_where(pred):
        return F.transform(F.filter(sums, pred), lambda x: x.k)

    none = F.array().cast("array<struct<k:string,c:bigint>>")
    places = F.when(F.size(bag) > 0, F.sequence(F.lit(0), F.size(bag) - 1)).otherwise(F.array().cast("array<int>"))
    return (
        df.withColumn("_bag", F.coalesce(F.sort_array(F.filter(keyed, lambda x: x.k.isNotNull())), none))
        .withColumn("_heads", F.filter(places, lambda i: (i == 0) | (bag[i].k != F.get(bag, i - 1).k)))
        .withColumn("_sums", F.transform(heads, run))
        .withColumn(f"{name}_keys", F.transform(sums, lambda x: x.k))
        .withColumn(
            f"{name}_sums",
            F.transform(
                F.filter(sums, lambda x: x.n != 0), lambda x: F.concat(x.n.cast("string"), F.lit(":"), x.k)
            ),
        )
        .withColumn(f"{name}_zero", keys_where(lambda x: x.n == 0))
        .withColumn(f"{name}_nonzero", keys_where(lambda x: x.n != 0))
        .drop("_bag", "_heads", "_sums")
    )


def _string_set(items: Column) -> Column:
    """Distinct ``str()`` of list elements; anything but a list is empty."""
    texts = F.transform(items, lambda x: F.to_json(x))
    return F.coalesce(F.array_distinct(F.transform(texts, J.py_str)), F.array().cast("array<string>"))


def _pair_set(items: Column) -> Column:
    def ends(p):
        return F.struct(F.to_json(p["leader_id"]).alias("a"), F.to_json(p["follower_id"]).alias("b"))

    def pair(x):
        return F.when(J.is_string(x.a) & J.is_string(x.b), F.concat_ws(",", x.a, x.b))

    return F.coalesce(
        F.array_distinct(F.array_compact(F.transform(F.transform(items, ends), pair))),
        F.array().cast("array<string>"),
    )


def _risk_shape() -> str:
    """What scoring reads of an element of the risk list."""
    observed = {slot.path: "variant" for slot in S.OBSERVATION_SLOTS}
    observed.update({f"{name}.vehicle_ids": "array<variant>" for name in S.ID_OBSERVATIONS})
    observed.update({f"{name}.pairs": f"array<{shape({'leader_id': 'variant', 'follower_id': 'variant'})}>" for name in S.PAIR_OBSERVATIONS})
    overall = {"risk_level.value": "variant", "main_risk_factors": "array<variant>"}
    return shape({"observations": shape(observed), "overall_risk_assessment": shape(overall)})


def _risk_columns(df: DataFrame) -> DataFrame:
    df = df.withColumn("_ra", F.try_variant_get("obj", "$['Risk Assessment'][0]", _risk_shape()))
    obs, overall = F.col("_ra")["observations"], F.col("_ra")["overall_risk_assessment"]
    df = df.withColumn("risk_ok", obs.isNotNull())
    df = _slot_columns(df, "obs", lambda path: F.to_json(at(obs, path)), S.OBSERVATION_SLOTS)

    def value_true(name):
        return F.coalesce(F.to_json(at(obs, f"{name}.value")) == "true", F.lit(False))

    pairs = S.PAIR_OBSERVATIONS
    return (
        df.withColumn("obs_ids", F.array(*[_string_set(at(obs, f"{k}.vehicle_ids")) for k in S.ID_OBSERVATIONS]))
        .withColumn("obs_true", F.array(*[value_true(k) for k in S.ID_OBSERVATIONS]))
        .withColumn("obs_pairs", F.array(*[_pair_set(at(obs, f"{k}.pairs")) for k in pairs]))
        .withColumn("pairs_true", F.array(*[value_true(k) for k in pairs]))
        .withColumn("risk_level", J.canon(F.to_json(at(overall, "risk_level.value"))))
        .withColumn("risk_factors", _string_set(at(overall, "main_risk_factors")))
        .drop("_ra")
    )


def with_features(docs: DataFrame) -> DataFrame:
    """Add all feature columns to parsed documents; Catalyst drops the unused ones."""
    df = _slot_columns(with_leaves(docs), "road", fixed, S.ROAD_SLOTS)
    df = _slot_columns(df, "env", fixed, S.ENVIRONMENT_SLOTS)
    df = _lane_columns(df)
    df = _event_columns(df, "veh", "_ve", S.VEHICLE_KEY)
    df = _event_columns(df, "ped", "_pe", S.PEDESTRIAN_KEY)
    return without_leaves(_risk_columns(df))
