"""Oracle queries for names, agreement, call bookkeeping and training sets."""

from checks.documents_sql import MODEL_NAME, MODEL_PAIRS, SLOTS, scores_ctes, with_base

_RUN_PAIRS = """SELECT s.k, g.m AS t, s.m FROM d s JOIN d g ON g.k = s.k AND g.m <> s.m
  WHERE s.m BETWEEN 1 AND 5 AND g.m BETWEEN 1 AND 5 AND NOT s.bad AND NOT g.bad"""

_WEIGHTS = """
weights AS (
  SELECT ids.k, ids.video_id,
    coalesce(least(1.0, greatest(0.0, avg(0.5 * global_slot_macro_acc + 0.5 * risk_obs_macro_acc))), 1.0) AS weight
  FROM (SELECT DISTINCT k, video_id FROM d WHERE m BETWEEN 1 AND 5 AND NOT bad) ids
  LEFT JOIN scores s ON s.k = ids.k AND s.t > 0 GROUP BY ALL
)"""

_GOLD_NAMES = """gold AS (SELECT o_orderkey AS k, concat('cam_', CAST(o_orderkey - o_orderkey % 2 AS STRING),
  CASE WHEN o_orderkey % 2 = 1 THEN '_b' ELSE '' END) AS video_id FROM orders)"""

_MATCHES = """
files AS (
  SELECT CASE m WHEN 1 THEN concat('question_', video_id, '_alpha_2b.json')
    WHEN 2 THEN concat(video_id, '_alpha-8b_json_answer.json')
    WHEN 3 THEN concat('12_question_', video_id, '_beta_integrated.json')
    WHEN 4 THEN concat('x', video_id, '_gamma.json')
    ELSE concat('question_', video_id, '_', video_id, '_.json') END AS file_name
  FROM gold CROSS JOIN range(1, 6) v(m)
),
parts AS (SELECT file_name, string_split(regexp_replace(file_name, '(_json_answer|_integrated)?\\.json$', ''), '_') AS a FROM files),
starts AS (SELECT *, unnest(range(1, len(a))) AS i FROM parts),
spans AS (SELECT *, unnest(range(i, len(a))) AS j FROM starts),
readings AS (
  SELECT file_name, i, array_to_string(a[i:j], '_') AS video_id, array_to_string(a[j + 1:len(a)], '_') AS model FROM spans
),
matches AS (
  SELECT concat('/results/', file_name) AS path, r.video_id, arg_min(model, i) AS model
  FROM readings r JOIN ids USING (video_id) WHERE model <> '' GROUP BY ALL
)"""

_RESULT_NAMES = """names AS (
  SELECT event_id, concat('question_cam', CAST(user_id AS STRING), CASE WHEN event_id % 5 = 0 THEN ''
    ELSE concat('_', lpad(CAST(event_id % 60 AS STRING), 2, '0'), 'm07s') END,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('_', event_type, CASE WHEN event_id % 3 = 0 THEN '_8B' ELSE '' END) END,
    CASE WHEN event_id % 13 = 0 THEN '_' ELSE '' END) AS stem FROM events
),
models AS (
  SELECT event_id, CASE WHEN l > 0 AND l < len(a) THEN array_to_string(a[l + 1:len(a)], '_') ELSE a[len(a)] END AS model
  FROM (
    SELECT event_id, a, coalesce((SELECT max(i) FROM (SELECT unnest(range(1, len(a) + 1)) AS i) WHERE regexp_matches(a[i], '^[0-9]+m[0-9]+s$')), 0) AS l
    FROM (SELECT event_id, string_split(stem, '_') AS a FROM names)
  )
)"""

_MEDIA = """media AS (
  SELECT doc_id, concat('/media/', source, '/', lang, CASE WHEN doc_id % 3 = 0 THEN ' (é)' ELSE '-' END,
    CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 0 THEN '..MP4' ELSE '.mp4' END) AS path,
    concat(lang, CASE WHEN doc_id % 3 = 0 THEN ' (é)' ELSE '-' END, CAST(doc_id AS STRING),
      CASE WHEN doc_id % 4 = 0 THEN '.' ELSE '' END) AS stem
  FROM documents)"""

_REPLIES = {
    "reply": [
        "props", "concat('note ', props, ' end } tail')", "concat('  ', props, chr(10))",
        "concat('{\"k\": ', CAST(event_id AS STRING))", "concat('[', props, ']')",
        "concat('see {\"a\":', props, ',\"b\":[1]} and {\"c\":1}')",
    ],
    "found": ["props", "props", "props", "NULL", "props", "concat('{\"a\":', props, ',\"b\":[1]}')"],
}


def _reply(kind, index):
    whens = " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(_REPLIES[kind]))
    return f"CASE ({index}) % 6 {whens} END"


_LABELS = """labelled AS (
  SELECT doc_id, concat('/set/', CAST(doc_id AS STRING), '.json') AS label_path,
    CASE doc_id % 5 WHEN 0 THEN concat('{"quality":', CAST(quality AS STRING), '}') WHEN 1 THEN NULL
      ELSE concat('{"quality":', CAST(quality AS STRING), ',"toxic":', CAST(toxic AS STRING), '}') END AS label
  FROM labels)"""

_PAIRS = """pairs AS (
  SELECT CAST(l.doc_id AS STRING) AS stem, label_path, concat('/set/', CAST(l.doc_id AS STRING), '.mp4') AS media_path
  FROM labelled l JOIN documents d ON d.doc_id = l.doc_id AND d.doc_id % 9 <> 0)"""

_TREE = """clips AS (
  SELECT doc_id, concat(source, '/', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '' ELSE '.x' END) AS rel_stem,
    CASE doc_id % 3 WHEN 0 THEN '.webm' ELSE '.mp4' END AS ext FROM documents)"""


def _split(source, ratio, seed):
    return f"""SELECT stem, CASE WHEN row_number() OVER (ORDER BY md5(concat('{seed}:', stem)))
      <= floor(count(*) OVER () * {ratio}) THEN 'train' ELSE 'test' END AS split FROM {source}"""


_METADATA = """CASE event_id % 7 WHEN 3 THEN 'expected_one_video' WHEN 4 THEN 'missing_label' ELSE 'bad_json' END"""

QUERIES = {
    "student_name_match": f"WITH {_GOLD_NAMES}, ids AS (SELECT video_id FROM gold), {_MATCHES} SELECT path, video_id, model FROM matches",
    "model_filter": f"""WITH {_GOLD_NAMES}, ids AS (SELECT video_id FROM gold), {_MATCHES}
      SELECT path, video_id, model FROM matches WHERE replace(model, '-', '_') IN ('alpha_2b', 'alpha_8b')""",
    "first_videos": f"WITH {_GOLD_NAMES} SELECT video_id FROM gold ORDER BY concat(video_id, '.json') LIMIT 500",
    "student_order": f"""WITH {_GOLD_NAMES}, ids AS (SELECT video_id FROM gold), {_MATCHES}
      SELECT path, video_id, model, row_number() OVER (PARTITION BY video_id ORDER BY model, path) AS position FROM matches""",
    "run_consensus_weight": with_base(
        SLOTS, scores_ctes(_RUN_PAIRS), _WEIGHTS, select="SELECT video_id, round(weight, 6) AS weight FROM weights"
    ),
    "weighted_summary": with_base(
        SLOTS, scores_ctes(f"{MODEL_PAIRS} UNION ALL {_RUN_PAIRS}"), _WEIGHTS,
        select=f"""SELECT {MODEL_NAME} AS model, count(*) AS n_videos,
          round(sum(global_slot_macro_acc * w) / sum(CASE WHEN global_slot_macro_acc IS NOT NULL THEN w END), 6) AS weight_global_slot_macro_acc_mean,
          round(sum(risk_obs_macro_acc * w) / sum(CASE WHEN risk_obs_macro_acc IS NOT NULL THEN w END), 6) AS weight_risk_obs_macro_acc_mean
          FROM (SELECT s.*, coalesce(weights.weight, 1.0) AS w FROM scores s LEFT JOIN weights ON weights.k = s.k WHERE s.t = 0)
          GROUP BY m""",
    ),
    "model_from_file_name": f"WITH {_RESULT_NAMES} SELECT event_id, model FROM models",
    "results_per_model": f"""WITH {_RESULT_NAMES} SELECT model, count(*) AS n_results FROM models WHERE model <> ''
      GROUP BY ROLLUP (model)""",
    "mean_latency": """SELECT length(event_type) AS position, event_type AS model,
        printf('%.4f', avg(value) FILTER (event_id % 7 <> 0)) AS avg_elapsed_s,
        concat(CAST(count(*) FILTER (event_id % 7 <> 0) AS STRING), '/', CAST(count(*) AS STRING)) AS success_total, '' AS notes
      FROM events GROUP BY event_type
      UNION ALL SELECT 7, 'offline', 'NA', concat('0/', CAST(count(*) AS STRING)), 'init_failed' FROM documents""",
    "pending_calls": f"""WITH {_MEDIA}, planned AS (SELECT * FROM media CROSS JOIN (VALUES ('alpha-2b'), ('beta'), ('gamma_x_7b'), ('delta')) v(model))
      SELECT path, model, concat(trim(regexp_replace(concat('question_', stem), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), '_', replace(model, '-', '_'), '.json') AS file_name
      FROM planned p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id AND p.model = CASE WHEN quality = 1 THEN 'alpha-2b' ELSE 'beta' END)""",
    "teacher_run_names": """SELECT o_orderkey AS k,
        CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN concat('cam_', CAST(o_orderkey AS STRING)) END AS stem FROM orders""",
    "pending_in_buckets": f"""WITH {_MEDIA}, planned AS (SELECT * FROM media CROSS JOIN (VALUES ('alpha-2b'), ('beta'), ('gamma_x_7b')) v(model))
      SELECT path, model, concat(trim(regexp_replace(concat('question_', stem), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), '_', replace(model, '-', '_'), '.json') AS file_name
      FROM planned p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id AND toxic IN (0, 1)
        AND p.model = CASE WHEN quality = 1 THEN 'alpha-2b' ELSE 'beta' END)""",
    "listed_files": """SELECT concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', CAST(doc_id AS VARCHAR), '.', kind) AS rel_path,
        strlen(coalesce(text, '')) AS length, sha256(coalesce(text, '')) AS content_sha256, kind IN ('mp4', 'MKV') AS is_media, kind = 'json' AS is_json
      FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'MKV' WHEN 2 THEN 'json' ELSE 'txt' END AS kind FROM documents)""",
    "first_media": f"WITH {_MEDIA} SELECT doc_id, path FROM media ORDER BY path LIMIT 25",
    "run_outcomes": f"""WITH {_MEDIA}
      SELECT path, run, concat(stem, '.teacher.perception_raw.run_', CAST(run AS STRING), '.json') AS file_name,
        CASE WHEN doc_id % 11 = 0 THEN concat('{{"video":"', path, '","model":"teacher-1","stage":"upload/activate","error":"not active"}}')
          WHEN (doc_id + run) % 7 = 0 THEN concat('{{"run":', CAST(run AS STRING), ',"stage":"perception_generate_or_parse","error":"run ',
            CAST(run AS STRING), '","elapsed_s":', CAST(CAST(run / 2 AS DOUBLE) AS STRING), '}}')
          ELSE concat('{{"doc":', CAST(doc_id AS STRING), '}}') END AS document
      FROM media CROSS JOIN range(1, 4) v(run) WHERE doc_id % 11 <> 0 OR run = 1""",
    "planned_runs": f"""WITH {_MEDIA} SELECT path, run, concat(stem, '.teacher.perception_raw.run_', CAST(run AS STRING), '.json') AS file_name
      FROM media CROSS JOIN range(1, 6) v(run)""",
    "first_json_object": f"SELECT event_id, {_reply('found', 'event_id')} AS found FROM events",
    "attempt_choice": f"""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'failed' WHEN retried THEN 'retry' ELSE 'first' END AS attempt,
        CASE WHEN event_id % 17 = 0 THEN NULL WHEN retried THEN coalesce({_reply('found', 'event_id + user_id')}, {_reply('reply', 'event_id + user_id')})
          ELSE coalesce({_reply('found', 'event_id')}, {_reply('reply', 'event_id')}) END AS response_text,
        CASE WHEN event_id % 17 = 0 THEN NULL WHEN retried THEN round(value + 1, 6) ELSE round(value, 6) END AS elapsed_s,
        CASE WHEN event_id % 17 = 0 THEN NULL WHEN retried THEN event_id + 1 ELSE event_id END AS total_token_count
      FROM (SELECT *, event_id % 6 = 3 AND event_id % 5 <> 0 AND event_id % 17 <> 0 AS retried FROM events)""",
    "call_outcomes": f"""SELECT event_id, status, CASE status
        WHEN 'exception' THEN CAST(json_object('error', concat('exception: timeout ', CAST(user_id AS STRING))) AS VARCHAR)
        WHEN 'ok' THEN reply ELSE CAST(json_object('error', status, 'raw_text', coalesce(reply, '')) AS VARCHAR) END AS document
      FROM (SELECT *, CASE WHEN event_id % 23 = 0 THEN 'exception' WHEN coalesce(reply, '') = '' THEN 'inference_failed'
          WHEN event_id % 6 IN (0, 2, 4) THEN 'ok' ELSE 'json_parse_failed' END AS status
        FROM (SELECT *, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '' ELSE {_reply('reply', 'event_id')} END AS reply FROM events))""",
    "token_usage": """SELECT event_type AS model, sum(event_id % 100) AS prompt_token_count,
      sum(event_id % 100 + user_id) AS total_token_count FROM events GROUP BY 1""",
    "media_data_url": """SELECT page_id, concat('data:video/', CASE page_id % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mov' ELSE 'webm' END,
      ';base64,', base64(encode(html))) AS data_url FROM pages""",
    "batch_call_stub": f"""WITH {_MEDIA} SELECT path, model, concat('{{"n":', CAST(length(path) AS STRING), '}}') AS response_text,
      round(length(path) / 10.0, 6) AS elapsed_s FROM media CROSS JOIN (VALUES ('alpha-2b'), ('beta')) v(model)""",
    "pair_media_labels": f"WITH {_LABELS}, {_PAIRS} SELECT stem, label_path, media_path FROM pairs",
    "unpaired_labels": f"""WITH {_LABELS}, {_PAIRS} SELECT CAST(doc_id AS STRING) AS stem, label_path FROM labelled
      WHERE CAST(doc_id AS STRING) NOT IN (SELECT stem FROM pairs)""",
    "pair_by_tree": f"""WITH {_TREE} SELECT rel_stem, concat('/v/', rel_stem, ext) AS media_path, concat('/l/', rel_stem, '.json') AS label_path
      FROM clips WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "unpaired_media": f"""WITH {_TREE} SELECT rel_stem, concat('/v/', rel_stem, ext) AS media_path
      FROM clips WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "exact_split": f"WITH {_LABELS}, {_PAIRS} {_split('pairs', 0.8, 42)}",
    "split_totals": f"""SELECT split, count(*) AS n_pairs FROM ({_split('(SELECT CAST(doc_id AS STRING) AS stem FROM documents)', 0.7, 7)})
      GROUP BY ROLLUP (split)""",
    "label_texts": f"WITH {_LABELS} SELECT label_path AS path, label FROM labelled",
    "chat_examples": """SELECT 'user' AS first_role, concat('file:///v/', CAST(doc_id AS STRING), '.mp4') AS video, 10 AS num_frames,
      'Describe the scene as one JSON object.' AS prompt, 'assistant' AS second_role, text AS answer FROM documents""",
    "chat_examples_from_metadata": """SELECT concat('file://', CASE event_id % 7 WHEN 1 THEN '/abs/' WHEN 2 THEN '/videos/one/' ELSE '/videos/rel/' END,
        CAST(event_id AS STRING), '.mp4') AS video,
        CASE event_id % 7 WHEN 1 THEN 'ok' WHEN 2 THEN concat('l', CAST(user_id AS STRING)) ELSE event_type END AS answer
      FROM events WHERE event_id % 7 IN (1, 2, 6)""",
    "metadata_rejects": f"SELECT {_METADATA} AS reason, count(*) AS n FROM events WHERE event_id % 7 IN (3, 4, 5) GROUP BY 1",
    "mask_and_truncate": """
      WITH ids AS (
        SELECT conv_id, turn, [unicode(c) for c in string_split(concat(role, text), '')] AS a,
          length(role) + CAST(turn * 40 AS INT) AS p FROM conversations
      ),
      cut AS (
        SELECT conv_id, turn, p, len(a) > 160 AND p >= 160 AS rejected,
          CASE WHEN len(a) > 160 THEN a[1:p] || a[len(a) - (160 - p) + 1:len(a)] ELSE a END AS a FROM ids
      )
      SELECT conv_id, turn, CASE WHEN NOT rejected THEN len(a) END AS n_tokens,
        CASE WHEN NOT rejected THEN coalesce(list_sum(a), 0) END AS id_sum,
        CASE WHEN NOT rejected THEN coalesce(list_sum(a[least(p, len(a)) + 1:len(a)]), 0) - 100 * least(p, len(a)) END AS label_sum,
        CASE WHEN NOT rejected THEN least(p, len(a)) END AS n_masked FROM cut""",
}
