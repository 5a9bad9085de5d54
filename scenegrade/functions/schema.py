"""Fixed values of the assessment format: field names, slots, gates, enums."""

from dataclasses import dataclass

# ---- fixed values: enum domains, by dotted path below the document root ----
ENUMS = {
    "road_composition.lane_directions.value": ["one_way", "two_way", "unknown"],
    "road_composition.road_type.value": ["urban", "suburban", "highway", "pedestrian_zone", "unknown"],
    "road_composition.pedestrian_crossings.type.value": ["zebra", "traffic_light_controlled", "other", "unknown"],
    "road_composition.traffic_lights.visible_state.value": ["red", "yellow", "green", "unknown"],
    "environmental_conditions.weather.value": ["clear", "rain", "snow", "fog", "storm", "unknown"],
    "environmental_conditions.precipitation_intensity.value": ["none", "light", "moderate", "heavy", "unknown"],
    "environmental_conditions.ambient_visibility.value": ["good", "reduced", "poor", "unknown"],
    "environmental_conditions.road_surface_condition.value": ["dry", "wet", "icy", "snow_covered", "unknown"],
    "environmental_conditions.lighting_conditions.value": [
        "daylight", "dusk_dawn", "night", "artificial_lighting", "unknown",
    ],
    "environmental_conditions.wind_conditions.value": ["calm", "windy", "strong_wind", "unknown"],
}
LANE_ENUMS = {
    "status": ["free", "slow", "congested", "stopped"],
    "vehicle_density": ["low", "medium", "high"],
}
VEHICLE_EVENT_ENUMS = {
    "event_type": [
        "speeding", "red_light_violation", "illegal_lane_change", "wrong_direction", "illegal_stop", "other",
    ],
    "involved_vehicle_type": ["car", "truck", "motorcycle", "bus", "unknown"],
    "risk_level": ["low", "medium", "high"],
}
PEDESTRIAN_EVENT_ENUMS = {
    "behavior": ["crossing_legally", "jaywalking", "waiting", "standing_in_road", "other"],
    "location": ["crosswalk", "sidewalk", "roadway", "median", "unknown"],
    "interaction_with_vehicles": ["none", "near_miss", "conflict"],
    "risk_level": ["low", "medium", "high"],
}
RISK_LEVELS = ["low", "medium", "high"]

# ---- fixed values: names ----
REQUIRED_SECTIONS = [
    "road_composition", "environmental_conditions", "traffic_status",
    "vehicle_events", "pedestrian_events", "Risk Assessment",
]
ROAD_FIELDS = ["number_of_lanes", "lane_directions", "road_type"]
ROAD_GROUPS = {
    "pedestrian_crossings": ["present", "type"],
    "traffic_lights": ["present", "visible_state"],
    "horizontal_signage": ["lane_markings", "stop_lines", "other_markings"],
    "vertical_signage": ["speed_limit", "warning_signs", "prohibition_signs"],
}
ENVIRONMENT_FIELDS = [
    "weather", "precipitation_intensity", "ambient_visibility",
    "road_surface_condition", "lighting_conditions", "wind_conditions",
]
ID_OBSERVATIONS = [
    "crossed_intersection", "motorcycle_without_helmet_observed", "lane_change_observed",
    "wrong_direction_observed", "blocking_stop_line_or_crosswalk_observed",
    "stopped_in_travel_lane_observed", "likely_high_speed_observed",
]
PAIR_OBSERVATIONS = ["tailgating_observed"]
OBSERVATIONS = ID_OBSERVATIONS + PAIR_OBSERVATIONS
VEHICLE_KEY = ["event_type", "involved_vehicle_type", "risk_level"]
PEDESTRIAN_KEY = ["behavior", "location", "risk_level"]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "webm"]

# A group member that says whether the rest of the group exists at all also
# gates the descriptive member next to it.
PRESENCE_GATED = {"type", "visible_state"}


@dataclass(frozen=True)
class Slot:
    """One scored leaf: where it lives and which gold leaves must be true."""

    path: str
    gates: tuple = ()


def _road_slots():
    for name in ROAD_FIELDS:
        base = f"road_composition.{name}"
        yield Slot(f"{base}.visible")
        yield Slot(f"{base}.value", (f"{base}.visible",))
    for group, members in ROAD_GROUPS.items():
        base = f"road_composition.{group}"
        yield Slot(f"{base}.visible")
        for member in members:
            gates = (f"{base}.visible",)
            if member in PRESENCE_GATED:
                gates += (f"{base}.present.value",)
            yield Slot(f"{base}.{member}.value", gates)


def _visible_value_slots(prefix, names):
    for name in names:
        yield Slot(f"{prefix}{name}.visible")
        yield Slot(f"{prefix}{name}.value", (f"{prefix}{name}.visible",))


ROAD_SLOTS = list(_road_slots())
ENVIRONMENT_SLOTS = list(_visible_value_slots("environmental_conditions.", ENVIRONMENT_FIELDS))
OBSERVATION_SLOTS = list(_visible_value_slots("", OBSERVATIONS))
