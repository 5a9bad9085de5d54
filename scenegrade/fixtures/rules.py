"""Arithmetic that turns order and line keys into assessment documents.

Every rule is an SQL expression over integers, valid in Spark and in DuckDB, so
the documents Spark parses and the answers an oracle computes straight from the
keys come from one definition. ``k`` is the order key, ``m`` the version of the
document (0 = gold, 1.. = a model or a run), ``f`` a field number, and
``p s n q`` the part key, supplier key, line number and quantity of one line.
Only versions above 0 carry noise.
"""

from scenegrade.functions import schema as S

MODELS = {1: "alpha_2b", 2: "alpha-8b", 3: "beta", 4: "gamma_x_7b"}
RUNS = [1, 2, 3, 4, 5]


class Field:
    """One scalar field: number, section, path, shape, value kind and gates."""

    def __init__(self, f, section, path, shape, kind, domain=None, visible_by=None, present_by=None):
        self.f, self.section, self.path = f, section, path
        self.shape, self.kind, self.domain = shape, kind, domain or []
        self.visible_by = f if visible_by is None else visible_by
        self.present_by = present_by


def _fields():
    out = []

    def add(section, path, shape, kind, domain=None, visible_by=None, present_by=None):
        out.append(Field(len(out), section, path, shape, kind, domain, visible_by, present_by))
        return out[-1].f

    add("road", "number_of_lanes", "VVC", "lanes")
    for name in ["lane_directions", "road_type"]:
        add("road", name, "VVC", "enum", S.ENUMS[f"road_composition.{name}.value"])
    for group, names in S.ROAD_GROUPS.items():
        vis = add("road", group, "V", "none")
        present = None
        for name in names:
            domain = S.ENUMS.get(f"road_composition.{group}.{name}.value")
            kind = "enum" if domain else "speed" if name == "speed_limit" else "bool"
            number = add("road", f"{group}.{name}", "VC", kind, domain, vis, present if domain else None)
            if name == "present":
                present = number
    for name in S.ENVIRONMENT_FIELDS:
        add("env", name, "VVC", "enum", S.ENUMS[f"environmental_conditions.{name}.value"])
    for name in S.OBSERVATIONS:
        add("obs", name, "VVC", "tri")
    add("risk", "risk_level", "VC", "enum", S.RISK_LEVELS)
    return out


FIELDS = _fields()
BY_PATH = {(x.section, x.path): x for x in FIELDS}
RISK_FIELD = FIELDS[-1]


def pick(index, domain):
    """domain[index % n] as SQL."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(domain))
    return f"CASE ({index}) % {len(domain)} {whens} END"


def flag(condition):
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


# ---- whole-document conditions --------------------------------------------
CUT = "(m > 0 AND (k + m) % 97 = 0)"
WRAPPED = "(m > 0 AND (k + m) % 103 = 0)"
TRAILING = "(m > 0 AND (k + m) % 107 = 0)"
GOLD_CUT = "(m = 0 AND k % 211 = 0)"
UNPARSED = f"({CUT} OR {WRAPPED} OR {TRAILING} OR {GOLD_CUT})"
ERROR_DOC = "(m > 0 AND (k * 5 + m) % 23 = 0)"
NO_PEDESTRIANS = "(m > 0 AND (k + m) % 61 = 0)"
BAD_ENVIRONMENT = "(m > 0 AND (k + m * 5) % 73 = 0)"
NO_RISK = "(m > 0 AND (k + m) % 67 = 0)"
LIST_OBSERVATIONS = "(m > 0 AND (k + m) % 71 = 0)"
TRAFFIC_OBJECT = "(m = 0 AND k % 101 = 0)"
TRAFFIC_STRING = "(m > 0 AND (k + m) % 89 = 0)"
TRAFFIC_NULL = "(n_lines = 0 OR (m > 0 AND (k + m * 3) % 23 = 0))"


# ---- scalar fields ----------------------------------------------------------
def visible_missing(f):
    return f"(m > 0 AND (k * 5 + m * 3 + {f} * 7) % 29 = 0)"


def visible(f, is_lanes=None):
    base = f"((k + {f}) % 4 <> 0)"
    if is_lanes is None:
        is_lanes = f"{f} = 0"
    return f"((CASE WHEN {is_lanes} THEN n_lines > 0 ELSE {base} END) <> (m > 0 AND (k * 3 + m * 5 + {f}) % 11 = 0))"


def shift(f):
    return flag(f"m > 0 AND (k * 7 + m * 13 + {f} * 31) % 10 < 2 + m")


def value_missing(f):
    return f"(m > 0 AND (k * 11 + m * 7 + {f} * 3) % 31 = 0)"


def moved(f):
    return f"(k + {f} + {shift(f)})"


def bool_value(f):
    return f"({moved(f)} % 3 = 0)"


def bool_as_number(f):
    return f"(m > 0 AND (k + m * 2 + {f}) % 37 = 0)"


LANES_UNKNOWN = "((k + m) % 19 = 0)"
LANES_VALUE = f"(n_lines + {shift(0)})"


def speed_unknown(f):
    return f"((k + {f}) % 9 = 0)"


def speed_value(f):
    return f"(30 + 10 * ({moved(f)} % 5))"


TRI_WORDS = ["true", "true", "false"]  # of moved(f) % 4; else unknown


def tri_value(f):
    return f"CASE {moved(f)} % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'true' WHEN 2 THEN 'false' ELSE 'unknown' END"


def confidence_missing(f):
    return f"((k * 2 + m + {f}) % 43 = 0)"


def confidence_bad(f):
    return f"(m > 0 AND (k + m + {f}) % 53 = 0)"


def confidence_as_string(f):
    return f"((k + m + {f}) % 59 = 0)"


def hundredths(x):
    return f"concat('0.', lpad(CAST(({x}) % 100 AS STRING), 2, '0'))"


def confidence_hundredths(f):
    return f"k * 3 + m * 7 + {f} * 5"


def confidence(f):
    return f"CASE WHEN {confidence_bad(f)} THEN '1.5' ELSE {hundredths(confidence_hundredths(f))} END"


# ---- observations -----------------------------------------------------------
def no_ids(f):
    return f"((k + m + {f}) % 8 = 0)"


FIRST_ID = "concat('v', CAST(k % 7 AS STRING))"


def second_number(f):
    return f"(k + {f} + {flag(f'm > 0 AND (k + m * 2 + {f}) % 3 = 0')})"


def second_id(f):
    return f"concat('v', CAST({second_number(f)} % 5 AS STRING))"


MALFORMED_PAIR = "((k + m) % 10 = 0)"
CUSTOM_OBSERVATION = "(m > 0 AND (k + m) % 4 = 0)"
CUSTOM_NAME = "concat('custom_', CAST(k % 3 AS STRING), '_observed')"
CUSTOM_ID = "concat('x', CAST(m AS STRING))"
FACTOR_1 = "concat('f', CAST(k % 4 AS STRING))"
FACTOR_2_NUMBER = f"(k + {flag('m > 0 AND (k + m) % 3 = 0')})"
FACTOR_2 = f"concat('f', CAST({FACTOR_2_NUMBER} % 5 AS STRING))"
NUMBER_FACTOR = "(k % 6 = 0)"  # factors also hold the number 3


# ---- one line: lane, vehicle event, pedestrian event -------------------------
# *_AT is the place of a value in its domain before the remainder, *_HUNDREDTHS a confidence before it
LANE_DROPPED = "(m > 0 AND (p * 3 + m * 7 + n) % 13 = 0)"
LANE_ID_AS_STRING = "(m > 0 AND (p + s + m) % 41 = 0)"
LANE_STATUS_MISSING = "((s + m) % 17 = 0)"
LANE_STATUS_AT = f"p + {flag('m > 0 AND (p + m) % 5 = 0')}"
LANE_STATUS = pick(LANE_STATUS_AT, S.LANE_ENUMS["status"])
LANE_DENSITY_MISSING = "((p + m * 2) % 19 = 0)"
LANE_DENSITY_WRONG = "(m > 0 AND (p * 2 + s + m) % 43 = 0)"  # a density that is none
LANE_DENSITY_AT = f"s + {flag('m > 0 AND (s + m) % 6 = 0')}"
_DENSITY = pick(LANE_DENSITY_AT, S.LANE_ENUMS["vehicle_density"])
LANE_DENSITY = f"CASE WHEN {LANE_DENSITY_WRONG} THEN 'packed' ELSE {_DENSITY} END"
LANE_STATUS_HUNDREDTHS = "p * 3 + s + m * 7"
LANE_STATUS_CONFIDENCE = hundredths(LANE_STATUS_HUNDREDTHS)
LANE_DENSITY_HUNDREDTHS = "p + s * 3 + m * 5"
LANE_DENSITY_CONFIDENCE = hundredths(LANE_DENSITY_HUNDREDTHS)

VEHICLE_DROPPED = "(m > 0 AND (p * 5 + m * 3) % 11 = 0)"
VEHICLE_TYPE_AS_NUMBER = "(m > 0 AND (p + s + m) % 47 = 0)"  # event_type is the number 7
VEHICLE_EVENT_TYPE_AT = "p"
VEHICLE_EVENT_TYPE = pick(VEHICLE_EVENT_TYPE_AT, S.VEHICLE_EVENT_ENUMS["event_type"])
VEHICLE_INVOLVED_AT = "s"
VEHICLE_INVOLVED = pick(VEHICLE_INVOLVED_AT, S.VEHICLE_EVENT_ENUMS["involved_vehicle_type"])
VEHICLE_RISK_AT = f"p + s + {flag('m > 0 AND (p + s * 2 + m) % 9 = 0')}"
VEHICLE_RISK = pick(VEHICLE_RISK_AT, S.RISK_LEVELS)
VEHICLE_DESCRIPTION = "concat('case ', CAST((p + m) % 3 AS STRING))"
VEHICLE_CONFIDENCE_MISSING = "(m > 0 AND (p * 7 + s + m) % 31 = 0)"
VEHICLE_CONFIDENCE_BAD = "m > 0 AND (p + s * 3 + m) % 37 = 0"
VEHICLE_HUNDREDTHS = "p + s + m"
VEHICLE_CONFIDENCE = f"CASE WHEN {VEHICLE_CONFIDENCE_BAD} THEN '1.5' ELSE {hundredths(VEHICLE_HUNDREDTHS)} END"
VEHICLE_COUNT_AS_STRING = "((p + m) % 17 = 0)"
VEHICLE_COUNT = f"(CASE WHEN p % 13 = 0 THEN 0 ELSE q + {flag('m > 0 AND (s + m) % 6 = 0')} END)"

PEDESTRIAN_DROPPED = "(m > 0 AND (s * 5 + m * 3) % 11 = 0)"
PEDESTRIAN_BEHAVIOR_AT = "s"
PEDESTRIAN_BEHAVIOR = pick(PEDESTRIAN_BEHAVIOR_AT, S.PEDESTRIAN_EVENT_ENUMS["behavior"])
PEDESTRIAN_LOCATION_AT = "p"
PEDESTRIAN_LOCATION = pick(PEDESTRIAN_LOCATION_AT, S.PEDESTRIAN_EVENT_ENUMS["location"])
PEDESTRIAN_INTERACTION_WRONG = "(m > 0 AND (p + s * 2 + m) % 29 = 0)"  # an interaction that is none
PEDESTRIAN_INTERACTION_AT = "p + s"
PEDESTRIAN_INTERACTION = f"CASE WHEN {PEDESTRIAN_INTERACTION_WRONG} THEN 'odd' ELSE {pick(PEDESTRIAN_INTERACTION_AT, S.PEDESTRIAN_EVENT_ENUMS['interaction_with_vehicles'])} END"
PEDESTRIAN_RISK_AT = f"p + {flag('m > 0 AND (p + m) % 7 = 0')}"
PEDESTRIAN_RISK = pick(PEDESTRIAN_RISK_AT, S.RISK_LEVELS)
PEDESTRIAN_CONFIDENCE_MISSING = "(m > 0 AND (p + s * 5 + m) % 41 = 0)"
PEDESTRIAN_CONFIDENCE_BAD = "m > 0 AND (p * 3 + s + m) % 33 = 0"
PEDESTRIAN_HUNDREDTHS = "p * 7 + s + m"
PEDESTRIAN_CONFIDENCE = f"CASE WHEN {PEDESTRIAN_CONFIDENCE_BAD} THEN '2.5' ELSE {hundredths(PEDESTRIAN_HUNDREDTHS)} END"
PEDESTRIAN_COUNT = f"(n + {flag('m > 0 AND (p + m) % 6 = 0')})"
