"""Registered queries: each reads the given tables and runs one operator family."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from scenegrade import configure
from scenegrade.fixtures import documents as D
from scenegrade.functions import json_docs as J
from scenegrade.functions import names as N
from scenegrade.functions import responses
from scenegrade.operators import calls as calls_ops
from scenegrade.operators import consensus as C
from scenegrade.operators import rates
from scenegrade.operators import trainset as T
from scenegrade.operators.agreement import run_agreement
from scenegrade.operators.naming import match_students, sorted_students
from scenegrade.operators.score import METRICS, score_pairs
from scenegrade.operators.validate import error_summary, with_validation
from scenegrade.plans import gold as G
from scenegrade.plans import leaderboard as L
from scenegrade.plans import votes
from scenegrade.plans.evaluate import score_tables
from scenegrade.sources import manifest, results, store
from scenegrade.sources.files import media_data_urls

QUERIES = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def gold(spark, sf_dir):
    return J.parse_documents(D.gold_texts(spark, sf_dir))


def students(spark, sf_dir):
    return J.parse_documents(D.student_texts(spark, sf_dir))


@query
def doc_parse_rates(spark, sf_dir):
    return students(spark, sf_dir).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.col("parse_ok").cast("int")), 6).alias("parse_rate")
    )


@query
def doc_validation_flags(spark, sf_dir):
    checked = with_validation(students(spark, sf_dir))
    return checked.select("video_id", "model", "parse_ok", "schema_ok", "rule_ok")


@query
def doc_validation_errors(spark, sf_dir):
    checked = with_validation(students(spark, sf_dir))
    return checked.select(
        "video_id", "model", F.size("errors").alias("n_errors"), error_summary().alias("errors")
    )


@query
def dataset_rates(spark, sf_dir):
    return rates.dataset_rates(with_validation(students(spark, sf_dir)))


def _score_query(name, metrics):
    def run(spark, sf_dir):
        scored = score_pairs(gold(spark, sf_dir), students(spark, sf_dir))
        return rounded(scored.select("video_id", "model", *metrics), metrics)

    run.__name__ = name
    return query(run)


_score_query("slot_scores_road", ["road_composition_slot_macro_acc"])
_score_query("slot_scores_environment", ["environmental_conditions_slot_macro_acc"])
_score_query("traffic_scores", ["traffic_length_acc", "traffic_per_lane_macro_acc", "traffic_status_macro_acc"])
_score_query("vehicle_event_scores", ["vehicle_presence_f1", "vehicle_count_acc", "vehicle_events_macro_acc"])
_score_query(
    "pedestrian_event_scores", ["pedestrian_presence_f1", "pedestrian_count_acc", "pedestrian_events_macro_acc"]
)
_score_query(
    "risk_scores",
    [
        "risk_obs_macro_acc", "risk_vehicle_ids_f1", "risk_pairs_f1", "overall_risk_level_acc",
        "main_risk_factors_f1",
    ],
)


@query
def per_video_scores(spark, sf_dir):
    scores = L.flat_report(L.per_video_scores(gold(spark, sf_dir), students(spark, sf_dir)))
    return rounded(scores, METRICS).drop("student_path", "teacher_path")


@query
def model_summary(spark, sf_dir):
    summary = L.model_summary(L.per_video_scores(gold(spark, sf_dir), students(spark, sf_dir)))
    means = [c for c in summary.columns if c.endswith("_mean") or c.endswith("_rate")]
    unweighted = [c for c in means if not c.startswith("weight_")]
    ranked = L.ranked(summary)
    return rounded(ranked.select("model", "n_videos", *unweighted), unweighted)


def runs(spark, sf_dir):
    """Parsed teacher runs, stem and run number read from the file names."""
    files = D.run_texts(spark, sf_dir).select("file_name", "text")
    return C.with_validity(J.parse_documents(C.gather_runs(files), present=C.VALIDITY_KEYS))


def _consensus(spark, sf_dir, sections, **more):
    return C.consensus(runs(spark, sf_dir), sections, names=D.run_names(spark, sf_dir), **more)


@query
def run_gate(spark, sf_dir):
    return C.run_gate(runs(spark, sf_dir), min_valid=5)


@query
def rejected_runs(spark, sf_dir):
    return runs(spark, sf_dir).filter("not valid").select("stem", "run", "reject_reason")


@query
def consensus_slots(spark, sf_dir):
    return rounded(C.slots(_consensus(spark, sf_dir, ["road", "env"])), ["confidence"])


@query
def consensus_lanes(spark, sf_dir):
    lanes = C.visible_lanes(_consensus(spark, sf_dir, ["road", "lane"], slots=["number_of_lanes"]))
    return rounded(lanes, ["status_confidence", "density_confidence"])


@query
def consensus_vehicle_events(spark, sf_dir):
    return rounded(C.vehicle_events(_consensus(spark, sf_dir, ["veh"])), ["confidence"])


@query
def consensus_pedestrian_events(spark, sf_dir):
    return rounded(C.pedestrian_events(_consensus(spark, sf_dir, ["ped"])), ["confidence"])


@query
def consensus_observations(spark, sf_dir):
    voted = C.observations(_consensus(spark, sf_dir, ["obs"]))
    return rounded(voted.withColumn("members", F.array_join("members", ",")), ["confidence"])


@query
def consensus_risk(spark, sf_dir):
    voted = C.overall_risk(_consensus(spark, sf_dir, ["risk"]))
    return rounded(voted.withColumn("main_risk_factors", F.array_join("main_risk_factors", ",")), ["confidence"])


@query
def consensus_documents(spark, sf_dir):
    stored = store.write_runs(D.run_texts(spark, sf_dir).select("file_name", "text"), store.shared_path(spark, "runs"))
    return G.gold_documents(stored, min_valid=4)  # some videos have fewer, some four, some five


@query
def incremental_votes(spark, sf_dir):
    """The same runs merged in two batches; each votes the videos it touches again."""
    files = D.run_texts(spark, sf_dir).select("file_name", "text")
    path = store.shared_path(spark, "votes")
    for batch, numbers in enumerate(["[1-4]", "5"]):
        votes.add_runs(files.filter(F.col("file_name").rlike(f"run_0*{numbers}[.]json$")), path, batch, min_valid=4)
    return votes.current_documents(spark, path)


@query
def stored_leaderboard(spark, sf_dir):
    """Names matched and models scored over stores of gold documents and results, nothing parsed after the stores."""
    texts = D.student_texts(spark, sf_dir).select(
        F.concat(F.lit("/results/"), "video_id", F.lit("_"), "model", F.lit(".json")).alias("path"),
        F.concat("video_id", F.lit("_"), "model", F.lit(".json")).alias("file_name"), "text",
    )
    stores = [(D.gold_texts(spark, sf_dir), "gold"), (texts, "results")]
    _, summary = score_tables(*[store.write_documents(docs, store.shared_path(spark, name)) for docs, name in stores])
    names = ["parse_rate", "schema_rate", "rule_rate", "global_slot_macro_acc_mean", "vehicle_events_macro_acc_mean"]
    return rounded(summary.select("model", "n_videos", *names), names)


# ---- names and agreement ------------------------------------------------------
def _gold_names(spark, sf_dir):
    """Ids that are prefixes of each other: ``cam_4`` and ``cam_4_b``."""
    return D.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k",
        "concat('cam_', CAST(o_orderkey - o_orderkey % 2 AS STRING),"
        " CASE WHEN o_orderkey % 2 = 1 THEN '_b' ELSE '' END) AS video_id",
    )


def _student_names(spark, sf_dir):
    spread = _gold_names(spark, sf_dir).repartition(D.spread_partitions(spark), "k")  # few input bytes, many names
    named = spread.withColumn("m", F.explode(F.array(*[F.lit(m) for m in range(1, 6)])))
    return named.selectExpr(
        "concat('/results/', CASE m WHEN 1 THEN concat('question_', video_id, '_alpha_2b.json')"
        " WHEN 2 THEN concat(video_id, '_alpha-8b_json_answer.json')"
        " WHEN 3 THEN concat('12_question_', video_id, '_beta_integrated.json')"
        " WHEN 4 THEN concat('x', video_id, '_gamma.json')"
        " ELSE concat('question_', video_id, '_', video_id, '_.json') END) AS path"
    ).withColumn("file_name", N.base_name("path"))


@query
def student_name_match(spark, sf_dir):
    return match_students(_student_names(spark, sf_dir), _gold_names(spark, sf_dir).select("video_id"))


@query
def model_filter(spark, sf_dir):
    matched = match_students(_student_names(spark, sf_dir), _gold_names(spark, sf_dir).select("video_id"))
    return L.filter_models(matched, ["alpha-2b", "alpha_8b"])


@query
def first_videos(spark, sf_dir):
    """The limit is the feature: the first 500 gold documents in file-name order."""
    return L.first_videos(_gold_names(spark, sf_dir).select("video_id"), 500)


@query
def student_order(spark, sf_dir):
    matched = match_students(_student_names(spark, sf_dir), _gold_names(spark, sf_dir).select("video_id"))
    return sorted_students(matched)


@query
def teacher_run_names(spark, sf_dir):
    """Run files of both namings among files that are none."""
    files = D.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k",
        "concat('cam_', CAST(o_orderkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '.teacher.run_1.json'"
        " WHEN 1 THEN '.teacher.perception_raw.run_02.json' WHEN 2 THEN '.teacher.perception_integrated.json'"
        " WHEN 3 THEN '.json' WHEN 4 THEN '.teacher.run_a.b.json' ELSE '.teacher.run_1.txt' END) AS file_name",
    )
    return files.select("k", N.teacher_run_stem("file_name").alias("stem"))


@query
def run_consensus_weight(spark, sf_dir):
    return rounded(run_agreement(runs(spark, sf_dir)), ["weight"])


@query
def weighted_summary(spark, sf_dir):
    weights = run_agreement(runs(spark, sf_dir))
    scores = L.per_video_scores(gold(spark, sf_dir), students(spark, sf_dir), weights)
    names = ["weight_global_slot_macro_acc_mean", "weight_risk_obs_macro_acc_mean"]
    return rounded(L.model_summary(scores, weighted=True).select("model", "n_videos", *names), names)


# ---- files, calls and latency -------------------------------------------------
_RESULT_NAME = (
    "concat('question_cam', CAST(user_id AS STRING), CASE WHEN event_id % 5 = 0 THEN ''"
    " ELSE concat('_', lpad(CAST(event_id % 60 AS STRING), 2, '0'), 'm07s') END,"
    " CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('_', event_type, CASE WHEN event_id % 3 = 0 THEN '_8B' ELSE '' END) END,"
    " CASE WHEN event_id % 13 = 0 THEN '_' ELSE '' END, '.json')"
)


def _result_names(spark, sf_dir):
    return D.table(spark, sf_dir, "events").selectExpr("event_id", f"{_RESULT_NAME} AS file_name")


@query
def model_from_file_name(spark, sf_dir):
    files = _result_names(spark, sf_dir)
    return files.select("event_id", N.model_from_stem(N.strip_json("file_name")).alias("model"))


@query
def results_per_model(spark, sf_dir):
    return rates.results_per_model(_result_names(spark, sf_dir))


@query
def mean_latency(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    calls = events.selectExpr("event_type AS model", "event_id % 7 <> 0 AS ok", "value AS elapsed_s")
    # the model list is the distinct event types plus one that never started
    started = events.select(F.col("event_type").alias("model")).distinct().withColumn("init_ok", F.lit(True))
    listed = started.unionByName(started.agg(F.lit("offline").alias("model"), F.lit(False).alias("init_ok")))
    listed = listed.withColumn("position", F.length("model"))
    n_media = D.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    return rates.latency_lines(rates.mean_latency(calls, listed, n_media))


def _media(spark, sf_dir):
    """Documents as media files; every third name has characters to sanitise."""
    return D.table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "concat('/media/', source, '/', lang, CASE WHEN doc_id % 3 = 0 THEN ' (é)' ELSE '-' END,"
        " CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 0 THEN '..MP4' ELSE '.mp4' END) AS path",
    )


@query
def pending_calls(spark, sf_dir):
    media = _media(spark, sf_dir)
    done = media.join(D.table(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "path", "CASE WHEN quality = 1 THEN 'alpha-2b' ELSE 'beta' END AS model"
    )
    pending = calls_ops.pending_calls(media, ["alpha-2b", "beta", "alpha-2b", "gamma_x_7b", "delta"], done)
    return pending.select("path", "model", "file_name")


@query
def pending_in_buckets(spark, sf_dir):
    """Results stored in buckets, in two batches of which one is written twice; what is still to be called."""
    media = _media(spark, sf_dir)
    done = media.join(D.table(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "path", "CASE WHEN quality = 1 THEN 'alpha-2b' ELSE 'beta' END AS model", "'{}' AS document", "'ok' AS status", "toxic"
    )
    folder = store.shared_path(spark, "results")
    name = "results_" + folder.rsplit("-", 1)[-1]
    results.open_results(spark, name, folder, buckets=8)
    for batch in ("clean", "toxic", "clean"):
        results.write_batch(done.filter(F.col("toxic") == int(batch == "toxic")), name, batch)
    return results.pending_of(media, ["alpha-2b", "beta", "gamma_x_7b"], name).select("path", "model", "file_name")


@query
def listed_files(spark, sf_dir):
    """A file for every document, written by tasks and listed level by level: kinds and sizes."""
    folder = store.shared_path(spark, "files")
    kind = "CASE doc_id % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'MKV' WHEN 2 THEN 'json' ELSE 'txt' END"
    rows = D.table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', CAST(doc_id AS STRING), '.', {kind}) AS name")
    manifest.write_files(rows.select("name", F.col("text").cast("binary").alias("content")), folder)
    files = manifest.manifest(spark, folder)
    read = manifest.with_content(manifest.below(files)).selectExpr("rel_path", "length", "decode(content, 'UTF-8') AS text")
    media = manifest.media_of(files).selectExpr("rel_path", "true AS is_media")
    return read.join(media, "rel_path", "left").selectExpr(
        "rel_path", "length", "sha2(text, 256) AS content_sha256", "coalesce(is_media, false) AS is_media", "endswith(rel_path, '.json') AS is_json"
    )


@query
def planned_runs(spark, sf_dir):
    return calls_ops.planned_runs(_media(spark, sf_dir), 5).select("path", "run", "file_name")


@query
def first_media(spark, sf_dir):
    return calls_ops.first_media(_media(spark, sf_dir), limit=100, samples=25).select("doc_id", "path")


@query
def run_outcomes(spark, sf_dir):
    """Runs that answered, failed on their own, or failed for the whole video at the upload."""
    made = calls_ops.planned_runs(_media(spark, sf_dir), 3).selectExpr(
        "path", "run", "file_name", "concat('{\"doc\":', CAST(doc_id AS STRING), '}') AS response_text",
        "CASE WHEN doc_id % 11 = 0 THEN 'not active' WHEN (doc_id + run) % 7 = 0 THEN concat('run ', CAST(run AS STRING)) END AS error",
        "CASE WHEN doc_id % 11 = 0 THEN 'upload/activate' END AS stage", "CAST(run / 2 AS DOUBLE) AS elapsed_s",
    )
    return calls_ops.run_outcomes(made, "teacher-1")


_REPLY = {
    "clean": "props",
    "noted": "concat('note ', props, ' end } tail')",
    "spaced": "concat('  ', props, chr(10))",
    "broken": "concat('{\"k\": ', CAST(event_id AS STRING))",
    "list": "concat('[', props, ']')",
    "nested": "concat('see {\"a\":', props, ',\"b\":[1]} and {\"c\":1}')",
}


def _reply(index):
    whens = " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(_REPLY.values()))
    return f"CASE ({index}) % {len(_REPLY)} {whens} END"


@query
def first_json_object(spark, sf_dir):
    events = D.table(spark, sf_dir, "events").selectExpr("event_id", f"{_reply('event_id')} AS reply")
    return events.select("event_id", responses.first_json_object("reply").alias("found"))


@query
def attempt_choice(spark, sf_dir):
    calls = D.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        f"CASE WHEN event_id % 17 = 0 THEN NULL ELSE named_struct('response_text', trim({_reply('event_id')}),"
        " 'elapsed_s', value, 'usage', map('total_token_count', event_id)) END AS first",
        f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE named_struct('response_text', trim({_reply('event_id + user_id')}),"
        " 'elapsed_s', value + 1, 'usage', map('total_token_count', event_id + 1)) END AS retry",
    )
    chosen = calls_ops.choose_attempt(calls)
    return chosen.select(
        "event_id", "attempt", "response_text", F.round("elapsed_s", 6).alias("elapsed_s"),
        F.try_element_at("usage", F.lit("total_token_count")).alias("total_token_count"),
    )


@query
def call_outcomes(spark, sf_dir):
    results = D.table(spark, sf_dir, "events").selectExpr(
        "event_id", f"CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '' ELSE {_reply('event_id')} END AS response_text",
        "CASE WHEN event_id % 23 = 0 THEN concat('timeout ', CAST(user_id AS STRING)) END AS exception",
    )
    return calls_ops.call_outcomes(results).select("event_id", "status", "document")


@query
def token_usage(spark, sf_dir):
    calls = D.table(spark, sf_dir, "events").selectExpr(
        "event_type AS model",
        "map('prompt_token_count', event_id % 100, 'total_token_count', event_id % 100 + user_id) AS usage",
    )
    return calls_ops.token_usage(calls).select("model", "prompt_token_count", "total_token_count")


@query
def media_data_url(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CAST(html AS BINARY) AS content",
        "concat('/p/', CAST(page_id AS STRING), CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.MOV' ELSE '.webm' END) AS path",
    )
    return media_data_urls(pages).select("page_id", "data_url")


def _stub_model(batch):
    """Deterministic stand-in for a model: answers with the length of the path."""
    import pandas as pd

    return pd.DataFrame(
        {
            "response_text": [f'{{"n":{len(p)}}}' for p in batch["path"]],
            "elapsed_s": [len(p) / 10 for p in batch["path"]],
            "usage": [{"total_token_count": len(p)} for p in batch["path"]],
        }
    )


@query
def batch_call_stub(spark, sf_dir):
    pending = calls_ops.planned_calls(_media(spark, sf_dir).select("path"), ["alpha-2b", "beta"])
    done = calls_ops.batch_call(pending, _stub_model, spark.sparkContext.defaultParallelism)
    return done.select("path", "model", "response_text", F.round("elapsed_s", 6).alias("elapsed_s"))


# ---- training sets ------------------------------------------------------------
def _label_files(spark, sf_dir):
    return D.table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "concat('/set/', CAST(doc_id AS STRING), '.json') AS path",
        "CASE doc_id % 5 WHEN 0 THEN concat('\"{\\\\\"quality\\\\\":', CAST(quality AS STRING), '}\"')"
        " WHEN 1 THEN '{broken' ELSE concat('{\"quality\": ', CAST(quality AS STRING), ', \"toxic\": ', CAST(toxic AS STRING), '}') END AS text",
    )


def _clip_files(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").selectExpr(
        "concat('/set/', CAST(doc_id AS STRING), CASE WHEN doc_id % 9 = 0 THEN '.MP4' ELSE '.mp4' END) AS path"
    )


@query
def pair_media_labels(spark, sf_dir):
    pairs, _ = T.pair_by_stem(_label_files(spark, sf_dir).drop("doc_id"), _clip_files(spark, sf_dir))
    return pairs.select("stem", "label_path", "media_path")


@query
def unpaired_labels(spark, sf_dir):
    _, skipped = T.pair_by_stem(_label_files(spark, sf_dir).drop("doc_id"), _clip_files(spark, sf_dir))
    return skipped.select("stem", "label_path")


def _trees(spark, sf_dir):
    clips = D.table(spark, sf_dir, "documents").selectExpr(
        "concat('/v/', source, '/', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.webm' ELSE '.x.mp4' END) AS path"
    )
    labels = D.table(spark, sf_dir, "labels").join(
        D.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"
    ).selectExpr(
        "concat('/l/', source, '/', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.json' ELSE '.x.json' END) AS path"
    )
    return T.pair_by_tree(clips, labels, "/v", "/l/")


@query
def pair_by_tree(spark, sf_dir):
    return _trees(spark, sf_dir)[0].select("rel_stem", "media_path", "label_path")


@query
def unpaired_media(spark, sf_dir):
    return _trees(spark, sf_dir)[1].select("rel_stem", "media_path")


@query
def exact_split(spark, sf_dir):
    pairs, _ = T.pair_by_stem(_label_files(spark, sf_dir).drop("doc_id"), _clip_files(spark, sf_dir))
    return T.exact_split(pairs.select("stem"), 0.8, 42)


@query
def split_totals(spark, sf_dir):
    documents = D.table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS stem")
    return T.split_totals(T.exact_split(documents, 0.7, 7))


@query
def label_texts(spark, sf_dir):
    kept, rejects = T.label_texts(_label_files(spark, sf_dir).select("path", "text"))
    return kept.select("path", "label").unionByName(rejects.selectExpr("path", "CAST(NULL AS STRING) AS label"))


_PROMPT = "Describe the scene as one JSON object."


@query
def chat_examples(spark, sf_dir):
    examples = D.table(spark, sf_dir, "documents").selectExpr(
        "concat('/v/', CAST(doc_id AS STRING), '.mp4') AS video", "text AS label"
    )
    chats = T.chat_examples(examples, _PROMPT, 10)
    return chats.selectExpr(
        "messages[0].role AS first_role", "messages[0].content[0].video AS video",
        "messages[0].content[0].num_frames AS num_frames", "messages[0].content[1].text AS prompt",
        "messages[1].role AS second_role", "messages[1].content[0].text AS answer",
    )


_METADATA_LINE = (
    "CASE event_id % 7 WHEN 0 THEN '   ' WHEN 1 THEN concat('{\"video\":\"/abs/', CAST(event_id AS STRING), '.mp4\",\"label\":\"ok\"}')"
    " WHEN 2 THEN concat('{\"video\":[\"one/', CAST(event_id AS STRING), '.mp4\"],\"label\":\"l', CAST(user_id AS STRING), '\"}')"
    " WHEN 3 THEN '{\"video\":[\"a.mp4\",\"b.mp4\"],\"label\":\"x\"}' WHEN 4 THEN concat('{\"video\":\"rel/', CAST(event_id AS STRING), '.mp4\"}')"
    " WHEN 5 THEN '{\"video\":' ELSE concat('{\"video\":\"rel/', CAST(event_id AS STRING), '.mp4\",\"label\":\"', event_type, '\"}') END"
)


def _metadata(spark, sf_dir):
    lines = D.table(spark, sf_dir, "events").selectExpr(f"{_METADATA_LINE} AS value")
    return T.metadata_examples(lines, "/videos/")


@query
def chat_examples_from_metadata(spark, sf_dir):
    return T.chat_examples(_metadata(spark, sf_dir)[0], _PROMPT, 10).selectExpr(
        "messages[0].content[0].video AS video", "messages[1].content[0].text AS answer"
    )


@query
def metadata_rejects(spark, sf_dir):
    rejects = _metadata(spark, sf_dir)[1]
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _tokens(spark, sf_dir):
    """Token ids are the code points of the role and of the whole text."""
    codes = "transform(split({0}, ''), c -> ascii(c))"
    return D.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", f"concat({codes.format('role')}, {codes.format('text')}) AS input_ids",
        "length(role) + CAST(turn * 40 AS INT) AS prefix_len",
    )


@query
def mask_and_truncate(spark, sf_dir):
    kept, rejected = T.truncate_and_mask(_tokens(spark, sf_dir), 100, 60)
    summary = kept.select(
        "conv_id", "turn", F.size("input_ids").alias("n_tokens"),
        F.aggregate("input_ids", F.lit(0), lambda a, x: a + x).alias("id_sum"),
        F.aggregate("labels", F.lit(0), lambda a, x: a + x).alias("label_sum"),
        F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"),
    )
    nothing = [F.lit(None).cast("int").alias(c) for c in ["n_tokens", "id_sum", "label_sum", "n_masked"]]
    return summary.unionByName(rejected.select("conv_id", "turn", *nothing))
