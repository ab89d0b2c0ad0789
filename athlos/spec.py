"""Column roles of a session table, and the fixed vocabularies the operators need.

Every operator takes a :class:`SessionSpec` (or plain column lists) instead of hard-coded names, so the
same code runs on the athlete schema and on any other table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------------------------------------------
# Fixed values. These must equal the reference's values for equal results; they are stated here once, in their
# natural order, and imported everywhere else.
# ---------------------------------------------------------------------------------------------------------------

SENSOR_COLUMNS = (
    "heart_rate_bpm", "step_frequency_hz", "stride_length_m", "acceleration_mps2",
    "gyroscope_x", "gyroscope_y", "gyroscope_z",
    "accelerometer_x", "accelerometer_y", "accelerometer_z",
    "signal_energy", "dominant_freq_hz",
)
SCORE_COLUMNS = ("performance_score", "injury_risk_score")
# Columns kept out of numeric treatment by the cleaner.
NUMERIC_EXCLUDE = ("athlete_id", "session_id", "performance_score", "injury_risk_score", "timestamp")

# Ordered categories, lowest first; the code of a value is its position.
RISK_LEVELS = ("Faible", "Modéré", "Élevé", "Critique")
HR_ZONES = ("Zone_Basse", "Zone_Aerobie", "Zone_Anaerobie", "Zone_Max")
PERFORMANCE_LEVELS = ("Insuffisante", "Bonne", "Excellente")
ORDINAL_MAPS = {
    "risk_level": RISK_LEVELS,
    "hr_zone": HR_ZONES,
    "performance_level": PERFORMANCE_LEVELS,
}

# Nominal categories. Event flags are read in this order and the last set flag wins.
EVENT_TYPES = ("high_jump", "long_jump", "sprint")
UNKNOWN_EVENT = "unknown"
MOTION_CLASSES = ("acceleration_phase", "flight_phase", "landing", "start_phase")
ONE_HOT_VOCAB = {"event_type": EVENT_TYPES, "motion_class": MOTION_CLASSES}

LABEL_SEP = "__"
CRITICAL_ZONE = "Zone_Max"
CRITICAL_FLAG_VALUES = ("critical", "normal")

TRAINING_LABEL_PARTS = ("risk_level", "hr_zone", "performance_level", "event_type", "hr_critical_flag")
INJURY_LABEL_PARTS = ("risk_level", "hr_zone", "event_type")
TRAINING_PRED_COLUMNS = ("pred_risk_level", "pred_hr_zone", "pred_performance_level", "pred_event_type",
                         "pred_hr_critical_flag")
INJURY_PRED_COLUMNS = ("pred_risk_level", "pred_hr_zone", "pred_event_type")

TRAINING_NUMERIC_FEATURES = SENSOR_COLUMNS + SCORE_COLUMNS + ("hour", "dayofweek")
TRAINING_CATEGORICAL_FEATURES = ("risk_level", "hr_zone", "performance_level", "event_type")
INJURY_FLAG_FEATURES = (
    "event_type_high_jump", "event_type_long_jump", "event_type_sprint",
    "motion_class_acceleration_phase", "motion_class_flight_phase", "motion_class_landing",
    "motion_class_start_phase",
)
INJURY_NUMERIC_FEATURES = SENSOR_COLUMNS + SCORE_COLUMNS + ("risk_level_encoded", "hr_zone_encoded") + INJURY_FLAG_FEATURES
INJURY_CATEGORICAL_FEATURES = ("risk_level", "hr_zone", "event_type")

# Defaults used when a scoring input lacks a category, and the ordinal default for an unknown text.
INFERENCE_DEFAULTS = {"risk_level": "Modéré", "hr_zone": "Zone_Aerobie", "performance_level": "Bonne",
                      "event_type": "unknown"}
ORDINAL_DEFAULT_CODE = 1

MISSING_SHARE_MAX = 0.30
IQR_FACTOR = 1.5
TEST_SHARE = 0.10
CV_FOLDS = 5
SEARCH_DRAWS = 10
SEED = 42

# Texts shown when a predicted label has no lookup row: the label is appended, then ")".
TRAINING_FALLBACK_PREFIX = "(no recommendation text for label: "
INJURY_FALLBACK_PREFIX = "(aucune recommendation pour: "

# Dashboard analytics.
PERFORMANCE_BAND_CUTS = (70.0, 40.0)        # >=70, >=40, below
RISK_BAND_CUTS = (80.0, 60.0, 30.0)         # on score x 100: >=80, >=60, >=30, below
HIGH_RISK_SCORE = 0.6
TRAINING_PROFILE_KEYS = ("heart_rate_bpm", "performance_score", "step_frequency_hz", "stride_length_m",
                         "signal_energy", "acceleration_mps2")
INJURY_PROFILE_KEYS = ("heart_rate_bpm", "injury_risk_score", "step_frequency_hz", "stride_length_m",
                       "signal_energy", "acceleration_mps2")
TRAINING_INDICATOR_KEYS = ("heart_rate_bpm", "step_frequency_hz", "stride_length_m", "signal_energy")
INJURY_INDICATOR_KEYS = ("injury_risk_score", "heart_rate_bpm", "step_frequency_hz", "signal_energy")
TRAINING_ALERT_UPPER = ("ALERTE",)
TRAINING_ALERT_LOWER = ("arrêt",)
INJURY_ALERT_UPPER = ("ALERTE", "CRITIQUE", "ARRÊT", "ARRET")
TRAINING_PREVIEW_CHARS = 80
INJURY_PREVIEW_CHARS = 90
PREVIEW_ELLIPSIS = "…"
# Feature-family rules: the first substring found names the family (order matters).
TRAINING_FAMILY_RULES = ("performance_level", "hr_zone", "risk_level", "event_type", "heart_rate", "injury",
                         "performance_score")
INJURY_FAMILY_RULES = ("injury_risk", "risk_level", "hr_zone", "heart_rate", "event_type", "motion_class",
                       "performance")
IMPORTANCE_TOP_N = 15
IMPORTANCE_SHOWN = 14


@dataclass(frozen=True)
class SessionSpec:
    """Names of the columns an operator treats in each role."""

    id_columns: tuple[str, ...] = ("athlete_id", "session_id")
    time_column: str | None = "timestamp"
    sensor_columns: tuple[str, ...] = SENSOR_COLUMNS
    score_columns: tuple[str, ...] = SCORE_COLUMNS
    ordinal_maps: dict = field(default_factory=lambda: dict(ORDINAL_MAPS))
    one_hot_vocab: dict = field(default_factory=lambda: dict(ONE_HOT_VOCAB))
    text_column: str = "recommendation_entrainement"
    label_parts: tuple[str, ...] = TRAINING_LABEL_PARTS
    label_column: str = "target_label"
    order_key: tuple[str, ...] = ("timestamp", "session_id")
    partition_key: str = "athlete_id"
    pred_columns: tuple[str, ...] = TRAINING_PRED_COLUMNS
    fallback_prefix: str = TRAINING_FALLBACK_PREFIX
    numeric_features: tuple[str, ...] = TRAINING_NUMERIC_FEATURES
    categorical_features: tuple[str, ...] = TRAINING_CATEGORICAL_FEATURES
    flag_features: tuple[str, ...] = ()

    @property
    def numeric_columns(self) -> tuple[str, ...]:
        return self.sensor_columns

    def with_(self, **kw) -> "SessionSpec":
        return replace(self, **kw)


TRAINING_SPEC = SessionSpec()
INJURY_SPEC = SessionSpec(
    text_column="recommendation_blessure", label_parts=INJURY_LABEL_PARTS, pred_columns=INJURY_PRED_COLUMNS,
    fallback_prefix=INJURY_FALLBACK_PREFIX, numeric_features=INJURY_NUMERIC_FEATURES,
    categorical_features=INJURY_CATEGORICAL_FEATURES, flag_features=INJURY_FLAG_FEATURES)
