"""Schemas, vocabularies and constants of the telemetry engine, in one place."""

from __future__ import annotations

POINTS = "session_id string, us bigint, source string, metric string, value double, unit string"
SEGMENTS = "session_id string, start_us bigint, end_us bigint, stage string, is_brief boolean"
SESSIONS = "session_id string, start_us bigint, end_us bigint"

US = 1_000_000
MINUTE, HOUR = 60 * US, 3600 * US

# They must be these for right results.
METRICS = ("heart_rate", "hrv_rmssd", "steps", "temperature", "humidity", "pressure")
CONTINUOUS = ("heart_rate", "hrv_rmssd", "temperature", "humidity", "pressure")
ROOM_METRICS = ("temperature", "humidity", "pressure")
CANONICAL_UNIT = {"heart_rate": "bpm", "hrv_rmssd": "ms", "steps": "count", "temperature": "celsius", "humidity": "percent", "pressure": "hpa"}
HPA_PER_INHG, HPA_PER_KPA = 33.86389, 10.0
STAGES = ("awake", "light", "deep", "rem", "asleep", "restless", "unknown")
STAGE_TIE_ORDER = ("awake", "rem", "light", "deep", "asleep", "restless", "unknown")
STAGE_NAMES = {"wake": "awake", "awake": "awake", "light": "light", "core": "light", "deep": "deep", "rem": "rem", "asleep": "asleep", "restless": "restless", "unknown": "unknown"}
REASONS = ("malformed_point", "naive_timestamp", "non_mvp_metric", "non_finite_value", "inconvertible_unit", "invalid_source")
RESOLUTIONS_S, FALLBACK_RESOLUTION_S = (1, 5, 10, 15, 30, 60), 60
MAX_GAP_US = {"heart_rate": 5 * MINUTE, "hrv_rmssd": 15 * MINUTE, "temperature": 15 * MINUTE, "humidity": 15 * MINUTE, "pressure": 15 * MINUTE}
SMOOTHING_US = {"heart_rate": 5 * MINUTE, "hrv_rmssd": 15 * MINUTE, "steps": 15 * MINUTE, "temperature": 15 * MINUTE, "humidity": 15 * MINUTE, "pressure": 15 * MINUTE}
STEPS_HOLD_US = 60 * US
WINDOW_S, TARGETS_S, DEFAULT_TARGET_S = 0.5, (30, 120, 180, 300, 600), 180
ROOM_CHANGE = {"temperature": (1.0, 30 * MINUTE), "humidity": (5.0, 30 * MINUTE), "pressure": (1.0, 180 * MINUTE)}
EVENT_TYPES = (
    "sleep_onset", "final_awakening", "awakening", "light_transition", "deep_transition", "rem_transition", "movement_burst", "restless_period",
    "temperature_rise", "temperature_fall", "humidity_rise", "humidity_fall", "pressure_rise", "pressure_fall",
)
PINNED_EVENTS = ("sleep_onset", "final_awakening")
MERGE_US, MAX_EVENTS = 15 * MINUTE, 12
MOVEMENT_FULL, BURST, RESTLESS, TRANSIENT = 30.0, 0.6, 0.3, 0.1
WAKE_US, TRANSITION_US, RESTLESS_US = 5 * MINUTE, 10 * MINUTE, 10 * MINUTE
COVERAGE, NEARBY_US, MANUAL_CAP_US = 0.5, 14 * HOUR, 24 * HOUR
RANGES = {"heart_rate": (20, 250), "steps": (0, 300), "hrv_rmssd": (0, 500)}
LEAST_SPAN = {"heart_rate": 10.0, "hrv_rmssd": 10.0, "temperature": 2.0, "humidity": 10.0, "pressure": 3.0}
NEUTRAL, GLIDE_S, RATE_FAST, RATE_SLOW, RATE_NATURE = 0.5, 1.0, 0.5, 0.2, 0.08
CROSSFADE_S, RESTLESS_BOOST, TRANSIENTS_A_SECOND, BRIEF_AMPLITUDE = 2.0, 0.25, 4, 0.4
FAST_PARAMETERS = ("pulse_rate", "rhythmic_density", "intensity", "transient_density")
PARAMETERS = (*FAST_PARAMETERS, "brightness", "texture_density", "modulation")
BOOSTED = ("texture_density", "transient_density")
STATE_PRESETS = {"awake": "Awake", "light": "Light", "deep": "Deep", "rem": "REM", "asleep": "Light", "restless": "Light", "unknown": "Neutral"}
VARIATION_SCALES = {"temperature": 1.0, "humidity": 5.0, "pressure": 1.0}
