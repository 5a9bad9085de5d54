"""DuckDB answers for the document queries, computed from keys without JSON.

The shared ``rules`` say what each document holds; everything here is plain
relational SQL over one row per cell, line or slot.
"""

from scenegrade.fixtures import rules as R
from scenegrade.functions import schema as S

MODEL_NAME = "CASE m " + " ".join(f"WHEN {m} THEN '{n}'" for m, n in R.MODELS.items()) + " END"


def _fields_values():
    rows = []
    for x in R.FIELDS:
        domain = "[" + ", ".join(f"'{v}'" for v in x.domain) + "]::VARCHAR[]"
        present = "NULL" if x.present_by is None else x.present_by
        rows.append(
            f"({x.f}, '{x.section}', '{x.path}', '{x.shape}', '{x.kind}', {domain}, {x.visible_by}, {present})"
        )
    return ",\n".join(rows)


_VALUE = f"""CASE kind
  WHEN 'enum' THEN dom[({R.moved('f')} % len(dom)) + 1]
  WHEN 'bool' THEN CAST({R.bool_value('f')} AS VARCHAR)
  WHEN 'tri' THEN {R.tri_value('f')}
  WHEN 'lanes' THEN CASE WHEN {R.LANES_UNKNOWN} THEN 'unknown' ELSE CAST({R.LANES_VALUE} AS VARCHAR) END
  WHEN 'speed' THEN CASE WHEN {R.speed_unknown('f')} THEN 'unknown' ELSE CAST({R.speed_value('f')} AS VARCHAR) END
END"""

_ABSENT = f"""(err OR (section = 'env' AND {R.BAD_ENVIRONMENT}) OR (section IN ('obs', 'risk') AND {R.NO_RISK})
  OR (section = 'obs' AND {R.LIST_OBSERVATIONS}))"""

BASE = f"""
fields(f, section, path, shape, kind, dom, vis_f, pres_f) AS (VALUES {_fields_values()}),
d AS (
  SELECT *, CASE WHEN err THEN 'null' WHEN {R.TRAFFIC_OBJECT} OR {R.TRAFFIC_STRING} THEN 'other'
                 WHEN {R.TRAFFIC_NULL} THEN 'null' ELSE 'list' END AS ts_kind,
         NOT (err OR {R.NO_RISK} OR {R.LIST_OBSERVATIONS}) AS risk_ok
  FROM (
    SELECT *, {R.UNPARSED} AS bad, {R.ERROR_DOC} AS err, concat('clip_', CAST(k AS VARCHAR)) AS video_id
    FROM (
      SELECT o.o_orderkey AS k, v.m AS m, coalesce(c.n_lines, 0) AS n_lines
      FROM orders o CROSS JOIN range(0, @VERSIONS) v(m)
      LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) c ON c.l_orderkey = o.o_orderkey
    )
  )
),
cells AS (
  SELECT k, m, f, section, path, shape, kind,
    CASE WHEN {_ABSENT} OR shape = 'VC' OR {R.visible_missing('f')} THEN NULL
         ELSE CAST({R.visible('f')} AS VARCHAR) END AS vis,
    CASE WHEN {_ABSENT} OR shape = 'V' OR {R.value_missing('f')} THEN NULL ELSE {_VALUE} END AS val,
    kind = 'bool' AND {R.bool_as_number('f')} AS val_is_number,
    CASE WHEN {_ABSENT} OR shape = 'V' OR {R.confidence_missing('f')} THEN NULL
         ELSE CAST({R.confidence('f')} AS DOUBLE) END AS conf,
    {R.confidence_as_string('f')} AS conf_is_string
  FROM d CROSS JOIN fields
),
doc_lines AS (
  SELECT d.*, l_partkey AS p, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q,
         l_extendedprice AS e
  FROM d JOIN lineitem ON l_orderkey = k
  WHERE NOT err
),
lanes AS (
  SELECT *, row_number() OVER (PARTITION BY k, m ORDER BY n, p, s, e) - 1 AS i FROM (
    SELECT k, m, n, p, s, e, bad, {R.LANE_ID_AS_STRING} AS id_is_string,
      CASE WHEN {R.LANE_STATUS_MISSING} THEN NULL ELSE {R.LANE_STATUS} END AS status,
      CASE WHEN {R.LANE_DENSITY_MISSING} THEN NULL ELSE {R.LANE_DENSITY} END AS density,
      CAST({R.LANE_STATUS_CONFIDENCE} AS DOUBLE) AS status_conf, CAST({R.LANE_DENSITY_CONFIDENCE} AS DOUBLE) AS density_conf
    FROM doc_lines WHERE ts_kind = 'list' AND NOT {R.LANE_DROPPED})
),
vehicle AS (
  SELECT *, row_number() OVER (PARTITION BY k, m ORDER BY n, p, s, e) - 1 AS i FROM (
    SELECT k, m, n, p, s, e, bad, {R.VEHICLE_TYPE_AS_NUMBER} AS type_is_number, {R.VEHICLE_EVENT_TYPE} AS event_type,
      {R.VEHICLE_INVOLVED} AS involved, {R.VEHICLE_RISK} AS risk, {R.VEHICLE_DESCRIPTION} AS description,
      CASE WHEN {R.VEHICLE_CONFIDENCE_MISSING} THEN NULL ELSE CAST({R.VEHICLE_CONFIDENCE} AS DOUBLE) END AS conf, {R.VEHICLE_COUNT_AS_STRING} AS count_is_string, {R.VEHICLE_COUNT} AS cnt
    FROM doc_lines WHERE NOT {R.VEHICLE_DROPPED})
),
pedestrian AS (
  SELECT *, row_number() OVER (PARTITION BY k, m ORDER BY n, p, s, e) - 1 AS i FROM (
    SELECT k, m, n, p, s, e, bad, {R.PEDESTRIAN_BEHAVIOR} AS behavior, {R.PEDESTRIAN_LOCATION} AS location,
      {R.PEDESTRIAN_INTERACTION} AS interaction, {R.PEDESTRIAN_RISK} AS risk,
      CASE WHEN {R.PEDESTRIAN_CONFIDENCE_MISSING} THEN NULL ELSE CAST({R.PEDESTRIAN_CONFIDENCE} AS DOUBLE) END AS conf, {R.PEDESTRIAN_COUNT} AS cnt
    FROM doc_lines WHERE NOT {R.PEDESTRIAN_DROPPED} AND NOT {R.NO_PEDESTRIANS})
)"""

SLOTS = """
slots AS (
  SELECT f, section, 'visible' AS part, NULL AS vis_f, NULL AS pres_f FROM fields WHERE shape IN ('VVC', 'V')
  UNION ALL
  SELECT f, section, 'value', vis_f, pres_f FROM fields WHERE shape IN ('VVC', 'VC') AND section <> 'risk'
)"""


def scores_ctes(pairs: str) -> str:
    """CTEs ending in ``scores`` for the (k, t, m) triples of ``pairs``: gold version t, student version m.

    Each section has a CTE of its own before, so a query on one section builds nothing else.
    """
    return f"""
pairs AS ({pairs}),
slot_hits AS (
  SELECT pr.k, pr.t, pr.m, sl.section,
    sum(CASE WHEN (sl.part = 'visible' AND s.vis IS NOT DISTINCT FROM g.vis)
               OR (sl.part = 'value' AND s.val IS NOT DISTINCT FROM g.val) THEN 1 ELSE 0 END) AS hits,
    count(*) AS total
  FROM pairs pr CROSS JOIN slots sl
  JOIN cells g ON g.k = pr.k AND g.m = pr.t AND g.f = sl.f
  JOIN cells s ON s.k = pr.k AND s.m = pr.m AND s.f = sl.f
  LEFT JOIN cells gv ON gv.k = pr.k AND gv.m = pr.t AND gv.f = sl.vis_f
  LEFT JOIN cells gp ON gp.k = pr.k AND gp.m = pr.t AND gp.f = sl.pres_f
  WHERE sl.part = 'visible' OR (gv.vis = 'true' AND (sl.pres_f IS NULL OR (gp.val = 'true' AND NOT gp.val_is_number)))
  GROUP BY ALL
),
lane_map AS (
  SELECT * FROM lanes WHERE NOT id_is_string
  QUALIFY row_number() OVER (PARTITION BY k, m, n ORDER BY i DESC) = 1
),
lane_len AS (SELECT k, m, count(*) AS len FROM lanes GROUP BY ALL),
lane_hits AS (
  SELECT pr.k, pr.t, pr.m, count(*) * 3 AS total,
    sum(CASE WHEN s.n IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN s.status IS NOT DISTINCT FROM g.status THEN 1 ELSE 0 END
      + CASE WHEN s.density IS NOT DISTINCT FROM g.density THEN 1 ELSE 0 END) AS hits
  FROM pairs pr JOIN lane_map g ON g.k = pr.k AND g.m = pr.t
  LEFT JOIN lane_map s ON s.k = pr.k AND s.m = pr.m AND s.n = g.n
  GROUP BY ALL
),
traffic AS (
  SELECT pr.k, pr.t, pr.m,
    CASE WHEN g.ts_kind = 'null' THEN CASE WHEN s.ts_kind = 'null' THEN 1 ELSE 0 END
         WHEN g.ts_kind = 'list' AND s.ts_kind = 'list' AND coalesce(gl.len, 0) = coalesce(sl.len, 0) THEN 1
         ELSE 0 END AS length_hit,
    coalesce(h.hits, 0) AS hits, coalesce(h.total, 0) AS total
  FROM pairs pr JOIN d g ON g.k = pr.k AND g.m = pr.t JOIN d s ON s.k = pr.k AND s.m = pr.m
  LEFT JOIN lane_len gl ON gl.k = pr.k AND gl.m = pr.t LEFT JOIN lane_len sl ON sl.k = pr.k AND sl.m = pr.m
  LEFT JOIN lane_hits h ON h.k = pr.k AND h.t = pr.t AND h.m = pr.m
),
bags AS (
  SELECT 'veh' AS kind, k, m, event_type AS a, involved AS b, risk AS c,
         sum(CASE WHEN count_is_string THEN 0 ELSE cnt END) AS n
  FROM vehicle WHERE NOT type_is_number GROUP BY ALL
  UNION ALL
  SELECT 'ped', k, m, behavior, location, risk, sum(cnt) FROM pedestrian GROUP BY ALL
),
bag_sizes AS (SELECT kind, k, m, count(*) AS n FROM bags GROUP BY ALL),
bag_hits AS (
  SELECT pr.k, pr.t, pr.m, g.kind, count(s.kind) AS tp,
    sum(CASE WHEN coalesce(s.n, 0) = g.n THEN 1 ELSE 0 END) AS count_hits
  FROM pairs pr JOIN bags g ON g.k = pr.k AND g.m = pr.t
  LEFT JOIN bags s ON s.kind = g.kind AND s.k = pr.k AND s.m = pr.m AND s.a = g.a AND s.b = g.b AND s.c = g.c
  GROUP BY ALL
),
events AS (
  SELECT pr.k, pr.t, pr.m, kinds.kind,
    CASE WHEN coalesce(g.n, 0) + coalesce(s.n, 0) = 0 THEN 1.0
         ELSE 2.0 * coalesce(h.tp, 0) / (coalesce(g.n, 0) + coalesce(s.n, 0)) END AS presence,
    CASE WHEN coalesce(g.n, 0) = 0 THEN 1.0 ELSE 1.0 * h.count_hits / g.n END AS count_acc
  FROM pairs pr CROSS JOIN (VALUES ('veh'), ('ped')) kinds(kind)
  LEFT JOIN bag_sizes g ON g.kind = kinds.kind AND g.k = pr.k AND g.m = pr.t
  LEFT JOIN bag_sizes s ON s.kind = kinds.kind AND s.k = pr.k AND s.m = pr.m
  LEFT JOIN bag_hits h ON h.kind = kinds.kind AND h.k = pr.k AND h.t = pr.t AND h.m = pr.m
),
observed AS (
  SELECT c.k, c.m, c.f, c.val, c.path IN ({", ".join(f"'{x}'" for x in S.PAIR_OBSERVATIONS)}) AS is_pair,
    CASE WHEN {R.no_ids('c.f')} THEN [] ELSE list_distinct([{R.FIRST_ID}, {R.second_id('c.f')}]) END AS ids,
    CASE WHEN {R.no_ids('c.f')} THEN [] ELSE [concat({R.FIRST_ID}, '>', {R.second_id('c.f')})] END AS prs
  FROM cells c WHERE section = 'obs'
),
obs_f1 AS (
  SELECT pr.k, pr.t, pr.m, g.is_pair,
    avg(CASE WHEN len(gx) + len(sx) = 0 THEN 1.0
             ELSE 2.0 * len(list_intersect(gx, sx)) / (len(gx) + len(sx)) END) AS f1
  FROM pairs pr
  JOIN (SELECT *, CASE WHEN is_pair THEN prs ELSE ids END AS gx FROM observed) g ON g.k = pr.k AND g.m = pr.t AND g.val = 'true'
  JOIN (SELECT *, CASE WHEN is_pair THEN prs ELSE ids END AS sx FROM observed) s ON s.k = pr.k AND s.m = pr.m AND s.f = g.f
  GROUP BY ALL
),
factors AS (
  SELECT k, m, list_distinct([{R.FACTOR_1}, {R.FACTOR_2}] || CASE WHEN {R.NUMBER_FACTOR} THEN ['3'] ELSE [] END) AS fs FROM d
),
graded AS (
  SELECT pr.k, pr.t, pr.m, ds.video_id, ds.bad, dg.risk_ok AND ds.risk_ok AS risk_ok
  FROM pairs pr JOIN d ds ON ds.k = pr.k AND ds.m = pr.m JOIN d dg ON dg.k = pr.k AND dg.m = pr.t
),
road_scores AS (
  SELECT g.*, h.hits AS road_hits, h.total AS road_total,
    CASE WHEN NOT bad THEN 1.0 * h.hits / h.total END AS road_composition_slot_macro_acc
  FROM graded g JOIN slot_hits h ON h.k = g.k AND h.t = g.t AND h.m = g.m AND h.section = 'road'
),
environment_scores AS (
  SELECT g.*, h.hits AS env_hits, h.total AS env_total,
    CASE WHEN NOT bad THEN 1.0 * h.hits / h.total END AS environmental_conditions_slot_macro_acc
  FROM graded g JOIN slot_hits h ON h.k = g.k AND h.t = g.t AND h.m = g.m AND h.section = 'env'
),
lane_scores AS (
  SELECT g.*, length_hit, hits AS lane_hits, total AS lane_total,
    CASE WHEN NOT bad THEN CAST(length_hit AS DOUBLE) END AS traffic_length_acc,
    CASE WHEN NOT bad THEN CASE WHEN total = 0 THEN 0.0 ELSE 1.0 * hits / total END END AS traffic_per_lane_macro_acc,
    CASE WHEN NOT bad THEN 1.0 * (length_hit + hits) / (total + 1) END AS traffic_status_macro_acc
  FROM graded g JOIN traffic tr ON tr.k = g.k AND tr.t = g.t AND tr.m = g.m
),
vehicle_scores AS (
  SELECT g.*, presence AS vp, count_acc AS vc, CASE WHEN NOT bad THEN presence END AS vehicle_presence_f1,
    CASE WHEN NOT bad THEN count_acc END AS vehicle_count_acc,
    CASE WHEN NOT bad THEN (presence + count_acc) / 2 END AS vehicle_events_macro_acc
  FROM graded g JOIN events e ON e.k = g.k AND e.t = g.t AND e.m = g.m AND e.kind = 'veh'
),
pedestrian_scores AS (
  SELECT g.*, presence AS pp, count_acc AS pc, CASE WHEN NOT bad THEN presence END AS pedestrian_presence_f1,
    CASE WHEN NOT bad THEN count_acc END AS pedestrian_count_acc,
    CASE WHEN NOT bad THEN (presence + count_acc) / 2 END AS pedestrian_events_macro_acc
  FROM graded g JOIN events e ON e.k = g.k AND e.t = g.t AND e.m = g.m AND e.kind = 'ped'
),
risk_values AS (SELECT k, m, val FROM cells WHERE section = 'risk'),
risk_scores AS (
  SELECT g.*,
    CASE WHEN NOT bad THEN CASE WHEN risk_ok THEN 1.0 * ob.hits / ob.total ELSE 0.0 END END AS risk_obs_macro_acc,
    CASE WHEN NOT bad THEN CASE WHEN risk_ok THEN coalesce(fi.f1, 0) ELSE 0.0 END END AS risk_vehicle_ids_f1,
    CASE WHEN NOT bad THEN CASE WHEN risk_ok THEN coalesce(fp.f1, 0) ELSE 0.0 END END AS risk_pairs_f1,
    CASE WHEN NOT bad THEN CASE WHEN risk_ok AND sr.val IS NOT DISTINCT FROM gr.val THEN 1.0 ELSE 0.0 END END AS overall_risk_level_acc,
    CASE WHEN NOT bad THEN CASE WHEN risk_ok
      THEN 2.0 * len(list_intersect(gf.fs, sf.fs)) / (len(gf.fs) + len(sf.fs)) ELSE 0.0 END END AS main_risk_factors_f1
  FROM graded g JOIN slot_hits ob ON ob.k = g.k AND ob.t = g.t AND ob.m = g.m AND ob.section = 'obs'
  LEFT JOIN obs_f1 fi ON fi.k = g.k AND fi.t = g.t AND fi.m = g.m AND NOT fi.is_pair
  LEFT JOIN obs_f1 fp ON fp.k = g.k AND fp.t = g.t AND fp.m = g.m AND fp.is_pair
  JOIN risk_values sr ON sr.k = g.k AND sr.m = g.m JOIN risk_values gr ON gr.k = g.k AND gr.m = g.t
  JOIN factors sf ON sf.k = g.k AND sf.m = g.m JOIN factors gf ON gf.k = g.k AND gf.m = g.t
),
scores AS (
  SELECT k, t, m, r.video_id, r.bad,
    CASE WHEN NOT r.bad THEN (road_hits + env_hits + length_hit + lane_hits + vp + vc + pp + pc)
      / (road_total + env_total + lane_total + 5) END AS global_slot_macro_acc,
    COLUMNS('_(acc|f1)$')
  FROM road_scores r JOIN environment_scores USING (k, t, m) JOIN lane_scores USING (k, t, m)
  JOIN vehicle_scores USING (k, t, m) JOIN pedestrian_scores USING (k, t, m) JOIN risk_scores USING (k, t, m)
)"""


MODEL_PAIRS = """SELECT s.k, 0 AS t, s.m FROM d s JOIN d g ON g.k = s.k AND g.m = 0 AND NOT g.bad
  WHERE s.m BETWEEN 1 AND 4"""


def _enum_fields():
    paths = [p.split(".", 1)[1].removesuffix(".value") for p in S.ENUMS]
    sections = ["road" if p.startswith("road") else "env" for p in S.ENUMS]
    return [(R.BY_PATH[(s, p)].f, full) for s, p, full in zip(sections, paths, S.ENUMS)]


def _confidence_fields():
    road = [(R.BY_PATH[("road", x)].f, f"road_composition.{x}.confidence") for x in S.ROAD_FIELDS]
    env = [(R.BY_PATH[("env", x)].f, f"environmental_conditions.{x}.confidence") for x in S.ENVIRONMENT_FIELDS]
    return road + env


def _values(pairs):
    return ", ".join(f"({i}, {f}, '{p}')" for i, (f, p) in enumerate(pairs))


VALIDATION = f"""
conf_paths(pos, f, path) AS (VALUES {_values(_confidence_fields())}),
enum_paths(pos, f, path) AS (VALUES {_values(_enum_fields())}),
nol AS (
  SELECT d.k, d.m, d.ts_kind, c.vis, c.val, coalesce(l.len, 0) AS len
  FROM d JOIN cells c ON c.k = d.k AND c.m = d.m AND c.f = 0
  LEFT JOIN (SELECT k, m, count(*) AS len FROM lanes GROUP BY ALL) l ON l.k = d.k AND l.m = d.m
),
tags AS (
  SELECT k, m, 0 AS o1, x.o AS o2, 0 AS o3, 'missing_top_level:' || x.name AS tag
  FROM d JOIN (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(S.REQUIRED_SECTIONS))}) x(o, name)
    ON d.err OR (x.name = 'pedestrian_events' AND {R.NO_PEDESTRIANS})
  UNION ALL SELECT k, m, 1, 0, 0, 'not_object:road_composition' FROM d WHERE err
  UNION ALL SELECT k, m, 1, 1, 0, 'not_object:environmental_conditions' FROM d WHERE err OR {R.BAD_ENVIRONMENT}
  UNION ALL SELECT k, m, 1, 2, 0, 'traffic_status_not_null_or_list' FROM d WHERE ts_kind = 'other'
  UNION ALL SELECT k, m, 1, 3, 0, 'vehicle_events_not_list' FROM d WHERE err
  UNION ALL SELECT k, m, 1, 4, 0, 'pedestrian_events_not_list' FROM d WHERE err OR {R.NO_PEDESTRIANS}
  UNION ALL SELECT k, m, 1, 5, 0, 'risk_assessment_not_list' FROM d WHERE err
  UNION ALL SELECT k, m, 2, 0, 0, 'rule_lane:visible_true_but_traffic_status_null' FROM nol WHERE vis = 'true' AND ts_kind = 'null'
  UNION ALL SELECT k, m, 2, 1, 0, 'rule_lane:number_of_lanes.value_bad=None' FROM nol WHERE vis = 'true' AND val IS NULL
  UNION ALL SELECT k, m, 2, 2, 0, 'rule_lane:traffic_status_len_mismatch expected=' || val || ' got='
      || CASE ts_kind WHEN 'null' THEN '0' WHEN 'other' THEN '-1' ELSE CAST(len AS VARCHAR) END
    FROM nol WHERE vis = 'true' AND val IS NOT NULL AND val <> 'unknown' AND NOT (ts_kind = 'list' AND len = try_cast(val AS BIGINT))
  UNION ALL SELECT k, m, 2, 3, 0, 'rule_lane:visible_false_but_traffic_status_not_null' FROM nol WHERE vis = 'false' AND ts_kind <> 'null'
  UNION ALL SELECT k, m, 2, 4, 0, 'missing_or_bad_visible:road_composition.number_of_lanes.visible' FROM nol WHERE vis IS NULL
  UNION ALL SELECT c.k, c.m, 3, pos, 0, CASE WHEN conf IS NULL THEN 'missing_conf:' || cp.path
      ELSE 'bad_conf:' || cp.path || '=' || CAST(conf AS VARCHAR) END
    FROM cells c JOIN conf_paths cp ON cp.f = c.f WHERE conf IS NULL OR conf > 1
  UNION ALL SELECT k, m, 4, i, 0, 'missing_conf:traffic_status[' || i || '].status.confidence' FROM lanes
  UNION ALL SELECT k, m, 4.3, i, 0, CASE WHEN conf IS NULL THEN 'missing_conf:vehicle_events[' || i || '].confidence'
      ELSE 'bad_conf:vehicle_events[' || i || '].confidence=' || CAST(conf AS VARCHAR) END FROM vehicle WHERE conf IS NULL OR conf > 1
  UNION ALL SELECT k, m, 4.6, i, 0, CASE WHEN conf IS NULL THEN 'missing_conf:pedestrian_events[' || i || '].confidence'
      ELSE 'bad_conf:pedestrian_events[' || i || '].confidence=' || CAST(conf AS VARCHAR) END FROM pedestrian WHERE conf IS NULL OR conf > 1
  UNION ALL SELECT c.k, c.m, 5, pos, 0, 'missing_enum:' || ep.path FROM cells c JOIN enum_paths ep ON ep.f = c.f WHERE val IS NULL
  UNION ALL SELECT k, m, 6, i, 0, 'missing_enum:traffic_status[' || i || '].status.value' FROM lanes WHERE status IS NULL
  UNION ALL SELECT k, m, 6, i, 1, 'missing_enum:traffic_status[' || i || '].vehicle_density.value' FROM lanes WHERE density IS NULL
  UNION ALL SELECT k, m, 6, i, 1, 'bad_enum:traffic_status[' || i || '].vehicle_density.value=packed' FROM lanes WHERE density = 'packed'
  UNION ALL SELECT k, m, 7, i, 0, 'bad_enum:vehicle_events[' || i || '].event_type=7' FROM vehicle WHERE type_is_number
  UNION ALL SELECT k, m, 8, i, 0, 'bad_enum:pedestrian_events[' || i || '].interaction_with_vehicles=odd' FROM pedestrian WHERE interaction = 'odd'
),
validation AS (
  SELECT d.k, d.m, d.video_id, d.bad, NOT d.bad AS parse_ok,
    CASE WHEN d.bad THEN ['parse_failed_or_not_object'] ELSE coalesce(t.errors, []) END AS errors,
    NOT d.bad AND coalesce(t.n_schema, 0) = 0 AS schema_ok, NOT d.bad AND coalesce(t.n_rule, 0) = 0 AS rule_ok
  FROM d LEFT JOIN (
    SELECT k, m, list(tag ORDER BY o1, o2, o3) AS errors,
      count(*) FILTER (starts_with(tag, 'missing_top_level:') OR starts_with(tag, 'not_object:') OR suffix(tag, '_not_list')
        OR starts_with(tag, 'missing_enum:') OR starts_with(tag, 'bad_enum:')) AS n_schema,
      count(*) FILTER (starts_with(tag, 'bad_conf:') OR starts_with(tag, 'rule_lane:')
        OR starts_with(tag, 'missing_or_bad_visible:')) AS n_rule
    FROM tags GROUP BY ALL) t ON t.k = d.k AND t.m = d.m
)"""


def with_base(*ctes, select, versions=6):
    """``select`` over the document CTEs of versions 0 (gold) up to ``versions`` - 1."""
    return "WITH " + ",".join([BASE.replace("@VERSIONS", str(versions)), *ctes]) + "\n" + select
