"""Independent SQL (DuckDB dialect) for each registered query, over the driver's tables as views.

Written from the operator definitions, not from our Spark plans: statistics as SQL aggregates, windows as SQL
windows. Doubles are rounded to 6 places, integers are BIGINT, to match ``plans.catalog.out``.
"""

from __future__ import annotations

from ..spec import SENSOR_COLUMNS

SENSORS = list(SENSOR_COLUMNS)

SESSIONS = """sessions AS (
  SELECT
    'A' || CAST(user_id AS VARCHAR) AS athlete_id,
    event_id AS session_id,
    CASE WHEN event_id % 37 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "timestamp",
    CASE WHEN event_id % 50 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS heart_rate_bpm,
    CASE WHEN event_id % 50 = 0 OR event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 10 END
      AS step_frequency_hz,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(user_id % 40 AS DOUBLE) / 20 END AS stride_length_m,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE value - 50 END AS acceleration_mps2,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id % 7 - 3 AS DOUBLE) END AS gyroscope_x,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id % 11 - 5 AS DOUBLE) END AS gyroscope_y,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id % 5 - 2 AS DOUBLE) END AS gyroscope_z,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) END AS accelerometer_x,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(user_id % 9 AS DOUBLE) END AS accelerometer_y,
    CASE WHEN event_id % 50 = 0 OR event_id % 3 = 0 THEN NULL ELSE value * 3 END AS accelerometer_z,
    CASE WHEN event_id % 50 = 0 OR event_id % 11 = 0 THEN NULL
         ELSE TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS signal_energy,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE value / 2 END AS dominant_freq_hz,
    least(value, CAST(100 AS DOUBLE)) AS performance_score,
    least(value / 200, CAST(1 AS DOUBLE)) AS injury_risk_score,
    CASE WHEN event_id % 19 = 0 THEN NULL WHEN value >= 100 THEN 'Critique' WHEN value >= 60 THEN 'Élevé'
         WHEN value >= 25 THEN 'Modéré' ELSE 'Faible' END AS risk_level,
    CASE WHEN event_id % 23 = 0 THEN NULL WHEN value >= 150 THEN 'Zone_Max' WHEN value >= 70 THEN 'Zone_Anaerobie'
         WHEN value >= 20 THEN 'Zone_Aerobie' ELSE 'Zone_Basse' END AS hr_zone,
    CASE WHEN value >= 70 THEN 'Excellente' WHEN value >= 40 THEN 'Bonne' ELSE 'Insuffisante' END
      AS performance_level,
    CASE event_type WHEN 'click' THEN 'sprint' WHEN 'view' THEN 'high_jump' WHEN 'purchase' THEN 'long_jump'
         ELSE 'unknown' END AS event_type,
    CASE event_id % 4 WHEN 0 THEN 'acceleration_phase' WHEN 1 THEN 'flight_phase' WHEN 2 THEN 'landing'
         ELSE 'start_phase' END AS motion_class,
    CASE WHEN event_id % 29 = 0 THEN NULL
         ELSE 'Niveau ' || CAST(event_id % 6 AS VARCHAR) || ' | Session ' || event_type
              || CASE WHEN value >= 100 THEN ' | ALERTE: charge critique, arrêt conseillé' ELSE '' END
              || CASE WHEN event_id % 10 = 0 THEN ' |  | récupération active |' ELSE '' END
    END AS recommendation_entrainement
  FROM events)"""


def _mode(col: str, table: str = "sessions") -> str:
    return (f"(SELECT {col} FROM {table} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1)")


LABELLED = f"""labelled AS (
  SELECT s.* REPLACE (
           coalesce(risk_level, {_mode('risk_level')}) AS risk_level,
           coalesce(hr_zone, {_mode('hr_zone')}) AS hr_zone,
           coalesce(performance_level, {_mode('performance_level')}) AS performance_level),
         CASE WHEN coalesce(hr_zone, {_mode('hr_zone')}) = 'Zone_Max' THEN 'critical' ELSE 'normal' END
           AS hr_critical_flag
  FROM sessions s),
labelled2 AS (
  SELECT *, coalesce(risk_level, '?') || '__' || coalesce(hr_zone, '?') || '__' || coalesce(performance_level, '?')
            || '__' || coalesce(event_type, '?') || '__' || coalesce(hr_critical_flag, '?') AS target_label
  FROM labelled)"""

RULE = """rule AS (
  SELECT *, risk_level AS actual,
         CASE WHEN injury_risk_score >= 0.5 THEN 'Critique' WHEN injury_risk_score >= 0.3 THEN 'Élevé'
              WHEN injury_risk_score >= 0.1 THEN 'Modéré' ELSE 'Faible' END AS predicted
  FROM labelled2)"""

PER_CLASS = """cm AS (SELECT actual, predicted, count(*) AS n FROM rule GROUP BY actual, predicted),
sup AS (SELECT actual AS class, sum(n) AS support FROM cm GROUP BY actual),
prd AS (SELECT predicted AS class, sum(n) AS predicted_n FROM cm GROUP BY predicted),
tp AS (SELECT actual AS class, n AS tp FROM cm WHERE actual = predicted),
pc0 AS (
  SELECT coalesce(sup.class, prd.class) AS class, coalesce(support, 0) AS support,
         coalesce(predicted_n, 0) AS predicted_n
  FROM sup FULL OUTER JOIN prd ON sup.class = prd.class),
pc1 AS (
  SELECT pc0.class, support, coalesce(tp, 0) AS tp,
         CASE WHEN predicted_n = 0 THEN 0.0 ELSE coalesce(tp, 0) / CAST(predicted_n AS DOUBLE) END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE coalesce(tp, 0) / CAST(support AS DOUBLE) END AS recall
  FROM pc0 LEFT JOIN tp ON pc0.class = tp.class),
pc AS (
  SELECT class, precision, recall,
         CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
         CAST(support AS BIGINT) AS support
  FROM pc1)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def _quartile_cte(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3")
    return f"b AS (SELECT {', '.join(parts)} FROM {table})"


def _clip(c: str) -> str:
    lo = f"(b.{c}_q1 - 1.5 * (b.{c}_q3 - b.{c}_q1))"
    hi = f"(b.{c}_q3 + 1.5 * (b.{c}_q3 - b.{c}_q1))"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {lo}), {hi}) END"


LINEITEM_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CODES = ["risk_level_encoded", "hr_zone_encoded", "performance_level_encoded"]
ORD = {
    "risk_level": ["Faible", "Modéré", "Élevé", "Critique"],
    "hr_zone": ["Zone_Basse", "Zone_Aerobie", "Zone_Anaerobie", "Zone_Max"],
    "performance_level": ["Insuffisante", "Bonne", "Excellente"],
}


def _ordinal(c: str, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {c} = '{v}' THEN {i}" for i, v in enumerate(ORD[c]))
    return f"CAST(CASE {whens} ELSE {default} END AS {'DOUBLE' if default == 'NULL' else 'BIGINT'})"


def _null_count(cols: list[str]) -> str:
    return " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in cols)


SESSION_COLUMNS = (["athlete_id", "session_id", '"timestamp"'] + SENSORS
                   + ["performance_score", "injury_risk_score", "risk_level", "hr_zone", "performance_level",
                      "event_type", "motion_class", "recommendation_entrainement"])


def _clean_sessions() -> str:
    clip = ", ".join(f"{_clip(c)} AS {c}" for c in SENSORS)
    rest = [c for c in SESSION_COLUMNS if c not in SENSORS]
    med = ", ".join(f"median({c}) AS {c}_m" for c in SENSORS)
    imp = ", ".join(f"coalesce({c}, m.{c}_m) AS {c}" for c in SENSORS)
    ms = ", ".join(f"avg({c}) AS {c}_mu, stddev_samp({c}) AS {c}_sd" for c in SENSORS)
    z = ", ".join(
        f"round(CASE WHEN z.{c}_sd IS NULL THEN NULL WHEN z.{c}_sd = 0 THEN {c} "
        f"ELSE ({c} - z.{c}_mu) / z.{c}_sd END, 6) AS {c}" for c in SENSORS)
    ev = ", ".join(f"CAST(CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS event_type_{v}"
                   for v in ["high_jump", "long_jump", "sprint"])
    mo = ", ".join(f"CAST(CASE WHEN motion_class = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS motion_class_{v}"
                   for v in ["acceleration_phase", "flight_phase", "landing", "start_phase"])
    codes = ", ".join(f"{_ordinal(c)} AS {c}_encoded" for c in ORD)
    return (_w(SESSIONS, "d AS (SELECT DISTINCT * FROM sessions)", _quartile_cte("d", SENSORS),
               f"c AS (SELECT {', '.join(rest)}, {clip} FROM d, b)",
               f"k AS (SELECT * FROM c WHERE {_null_count(SESSION_COLUMNS)} <= 0.3 * {len(SESSION_COLUMNS)})",
               f"m AS (SELECT {med} FROM k)",
               f"i AS (SELECT {', '.join(rest)}, {imp} FROM k, m)",
               f"z AS (SELECT {ms} FROM i)")
            + f"SELECT session_id, {z}, {codes}, {ev}, {mo} FROM i, z")


def _feature_spread() -> str:
    feats = SENSORS + ["performance_score", "injury_risk_score"]
    cols = ", ".join(f"stddev_samp(CAST({c} AS DOUBLE)) AS {c}" for c in feats + CODES)
    enc = ", ".join(f"{_ordinal(c)} AS {c}_encoded" for c in ORD)
    return (f"enc AS (SELECT *, {enc} FROM sessions),\n"
            f"one AS (SELECT {cols} FROM enc),\n"
            f"fs AS (UNPIVOT one ON {', '.join(feats + CODES)} INTO NAME feature VALUE weight)")


def _family(col: str, rules: list[str]) -> str:
    whens = " ".join(f"WHEN contains({col}, '{r}') THEN '{r}'" for r in rules)
    return f"CASE {whens} ELSE 'other' END"


TRAINING_RULES = ["performance_level", "hr_zone", "risk_level", "event_type", "heart_rate", "injury",
                  "performance_score"]


def _clauses(alert: str) -> str:
    return (_w(SESSIONS,
               "sp AS (SELECT session_id, unnest(string_split(recommendation_entrainement, '|')) AS raw, "
               "generate_subscripts(string_split(recommendation_entrainement, '|'), 1) AS i FROM sessions "
               "WHERE recommendation_entrainement IS NOT NULL)",
               "t AS (SELECT session_id, i, trim(raw) AS clause FROM sp WHERE length(trim(raw)) > 0)")
            + f"SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY i) AS BIGINT) "
              f"AS clause_no, clause, {alert} AS is_alert FROM t")


def _model_ranking() -> str:
    preds = {
        "bands_a": "CASE WHEN injury_risk_score >= 0.5 THEN 'Critique' WHEN injury_risk_score >= 0.3 THEN 'Élevé' "
                   "WHEN injury_risk_score >= 0.125 THEN 'Modéré' ELSE 'Faible' END",
        "bands_b": "CASE WHEN injury_risk_score >= 0.5 THEN 'Critique' WHEN injury_risk_score >= 0.3 THEN 'Élevé' "
                   "WHEN injury_risk_score >= 0.1 THEN 'Modéré' ELSE 'Faible' END",
        "constant": "'Modéré'",
    }
    rows = []
    ctes = [SESSIONS, LABELLED]
    for i, (name, p) in enumerate(preds.items()):
        ctes.append(f"""cm{i} AS (SELECT risk_level AS actual, {p} AS predicted, count(*) AS n FROM labelled2
                 GROUP BY 1, 2),
sup{i} AS (SELECT actual AS class, sum(n) AS support FROM cm{i} GROUP BY 1),
prd{i} AS (SELECT predicted AS class, sum(n) AS pn FROM cm{i} GROUP BY 1),
tp{i} AS (SELECT actual AS class, n AS tp FROM cm{i} WHERE actual = predicted),
pc{i} AS (
  SELECT coalesce(s.support, 0) AS support, coalesce(t.tp, 0) AS tp,
         CASE WHEN coalesce(p.pn, 0) = 0 THEN 0.0 ELSE coalesce(t.tp, 0) / CAST(p.pn AS DOUBLE) END AS pr,
         CASE WHEN coalesce(s.support, 0) = 0 THEN 0.0 ELSE coalesce(t.tp, 0) / CAST(s.support AS DOUBLE) END AS rc
  FROM sup{i} s FULL OUTER JOIN prd{i} p ON s.class = p.class
  LEFT JOIN tp{i} t ON coalesce(s.class, p.class) = t.class),
m{i} AS (
  SELECT '{name}' AS model, CAST({i} AS BIGINT) AS ord,
         sum(rc * support) / sum(support) AS accuracy,
         sum(pr * support) / sum(support) AS precision,
         sum(rc * support) / sum(support) AS recall,
         round(sum(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END * support) / sum(support), 9)
           AS f1
  FROM pc{i})""")
        rows.append(f"SELECT * FROM m{i}")
    ctes.append("allm AS (" + " UNION ALL ".join(rows) + ")")
    return (_w(*ctes) + "SELECT model, ord, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, "
            "round(recall, 6) AS recall, round(f1, 6) AS f1, "
            "CAST(row_number() OVER (ORDER BY f1 DESC, ord) AS BIGINT) AS rank, "
            "row_number() OVER (ORDER BY f1 DESC, ord) = 1 AS is_best FROM allm")


def _profile() -> str:
    keys = ["heart_rate_bpm", "performance_score", "step_frequency_hz", "stride_length_m", "signal_energy",
            "acceleration_mps2"]
    sel = []
    for k in keys:
        if k == "performance_score":
            e = f"least(greatest(coalesce({k}, 50.0) / 100, 0.0), 1.0)"
        else:
            e = f"least(greatest((coalesce({k}, 0.0) + 3) / 6, 0.0), 1.0)"
        sel.append(f"CAST({e} AS DOUBLE) AS {k}")
    return (_w(SESSIONS, f"p AS (SELECT session_id, {', '.join(sel)} FROM sessions)")
            + f"SELECT session_id, metric, round(value, 6) AS value FROM "
              f"(UNPIVOT p ON {', '.join(keys)} INTO NAME metric VALUE value)")


ORACLE: dict[str, str] = {
    "dedupe_rows":
        "SELECT DISTINCT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, round(value, 6) AS value, props "
        "FROM (SELECT * FROM events UNION ALL SELECT * FROM events)",
    "coerce_numeric":
        "WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props "
        "WHEN event_id % 3 = 1 THEN regexp_extract(props, '([0-9]+)', 1) "
        "ELSE regexp_extract(props, '([0-9]+)', 1) || '.5' END AS raw FROM events) "
        "SELECT event_id, raw, round(TRY_CAST(raw AS DOUBLE), 6) AS num FROM t",
    "sparse_row_filter":
        _w(SESSIONS) + f"SELECT session_id, athlete_id, CAST({_null_count(SESSION_COLUMNS)} AS BIGINT) AS n_missing "
        f"FROM sessions WHERE {_null_count(SESSION_COLUMNS)} <= 0.3 * {len(SESSION_COLUMNS)}",
    "column_quartiles":
        _w(SESSIONS) + "SELECT column_name, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) "
        f"AS q3 FROM (UNPIVOT sessions ON {', '.join(SENSORS)} INTO NAME column_name VALUE v) GROUP BY column_name",
    "iqr_clip":
        _w(_quartile_cte("lineitem", LINEITEM_NUMS)) + "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, "
        "CAST(l_linenumber AS BIGINT) AS l_linenumber, "
        + ", ".join(_r(_clip(c), c) for c in LINEITEM_NUMS) + " FROM lineitem, b",
    "iqr_clip_sessions":
        _w(SESSIONS, _quartile_cte("sessions", SENSORS)) + "SELECT session_id, "
        + ", ".join(_r(_clip(c), c) for c in SENSORS) + " FROM sessions, b",
    "median_impute":
        _w(SESSIONS, "m AS (SELECT " + ", ".join(f"median({c}) AS {c}_m" for c in SENSORS) + " FROM sessions)")
        + "SELECT session_id, " + ", ".join(_r(f"coalesce({c}, m.{c}_m)", c) for c in SENSORS)
        + " FROM sessions, m",
    "mode_impute":
        _w(SESSIONS) + f"SELECT session_id, coalesce(risk_level, {_mode('risk_level')}) AS risk_level, "
        f"coalesce(hr_zone, {_mode('hr_zone')}) AS hr_zone FROM sessions",
    "default_impute":
        _w(SESSIONS) + "SELECT session_id, coalesce(risk_level, 'Modéré') AS risk_level, "
        "coalesce(hr_zone, 'Zone_Aerobie') AS hr_zone, coalesce(performance_level, 'Bonne') AS performance_level, "
        "'unknown' AS event_type FROM sessions",
    "flags_fill":
        _w(SESSIONS) + "SELECT session_id, CAST(CASE WHEN risk_level = 'Critique' THEN 1 ELSE 0 END AS BIGINT) "
        "AS flag_critique, CAST(CASE WHEN hr_zone = 'Zone_Max' THEN 1 ELSE 0 END AS BIGINT) AS flag_zone_max, "
        "CAST(0 AS BIGINT) AS flag_absent FROM sessions",
    "minmax_scale":
        _w("b AS (SELECT " + ", ".join(f"min({c}) AS {c}_mn, max({c}) AS {c}_mx" for c in LINEITEM_NUMS)
           + " FROM lineitem)")
        + "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
        + ", ".join(_r(f"CASE WHEN b.{c}_mn = b.{c}_mx THEN {c} ELSE ({c} - b.{c}_mn) / (b.{c}_mx - b.{c}_mn) END",
                       c) for c in LINEITEM_NUMS) + " FROM lineitem, b",
    "zscore":
        "WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part), "
        "b AS (SELECT avg(p_size) AS s_mu, stddev_samp(p_size) AS s_sd, avg(p_retailprice) AS r_mu, "
        "stddev_samp(p_retailprice) AS r_sd FROM p) "
        "SELECT p_partkey, round(CASE WHEN s_sd = 0 THEN p_size ELSE (p_size - s_mu) / s_sd END, 6) AS p_size, "
        "round(CASE WHEN r_sd = 0 THEN p_retailprice ELSE (p_retailprice - r_mu) / r_sd END, 6) AS p_retailprice "
        "FROM p, b",
    "one_hot":
        _w(SESSIONS) + "SELECT session_id, "
        + ", ".join(f"CAST(CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS event_type_{v}"
                    for v in ["high_jump", "long_jump", "sprint", "unknown"]) + ", "
        + ", ".join(f"CAST(CASE WHEN motion_class = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS motion_class_{v}"
                    for v in ["acceleration_phase", "flight_phase", "landing", "start_phase"]) + " FROM sessions",
    "ordinal_encode":
        _w(SESSIONS) + "SELECT session_id, risk_level, hr_zone, performance_level, "
        + ", ".join(f"{_ordinal(c)} AS {c}_encoded" for c in ORD) + " FROM sessions",
    "ordinal_default":
        "SELECT o_orderkey, o_orderpriority, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 "
        "WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 1 END AS BIGINT) AS o_orderpriority_encoded FROM orders",
    "flags_to_category":
        _w(SESSIONS, "f AS (SELECT session_id, "
           "CASE WHEN event_type = 'high_jump' OR session_id % 7 = 0 THEN 1 ELSE 0 END AS hj, "
           "CASE WHEN event_type = 'long_jump' THEN 1 WHEN session_id % 5 = 0 THEN NULL ELSE 0 END AS lj, "
           "CASE WHEN event_type = 'sprint' OR session_id % 9 = 0 THEN 1 ELSE 0 END AS sp FROM sessions)")
        + "SELECT session_id, CASE WHEN coalesce(sp, 0) = 1 THEN 'sprint' WHEN coalesce(lj, 0) = 1 THEN 'long_jump' "
          "WHEN coalesce(hj, 0) = 1 THEN 'high_jump' ELSE 'unknown' END AS event_type FROM f",
    "category_flags":
        _w(SESSIONS) + "SELECT session_id, event_type, "
        + ", ".join(f"CAST(CASE WHEN event_type = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS event_type_{v}"
                    for v in ["high_jump", "long_jump", "sprint"]) + ", "
        + ", ".join(f"CAST(CASE WHEN motion_class = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS motion_class_{v}"
                    for v in ["acceleration_phase", "flight_phase", "landing", "start_phase"]) + " FROM sessions",
    "time_features":
        _w(SESSIONS) + "SELECT session_id, CAST(coalesce(hour(TRY_CAST(\"timestamp\" AS TIMESTAMP)), 0) AS BIGINT) "
        "AS hour, CAST(coalesce(isodow(TRY_CAST(\"timestamp\" AS TIMESTAMP)) - 1, 0) AS BIGINT) AS dayofweek "
        "FROM sessions",
    "hr_critical_flag":
        _w(SESSIONS) + "SELECT session_id, hr_zone, CASE WHEN hr_zone = 'Zone_Max' THEN 'critical' ELSE 'normal' END "
        "AS hr_critical_flag FROM sessions",
    "clean_sessions": _clean_sessions(),
    "composite_label": _w(SESSIONS, LABELLED) + "SELECT session_id, target_label FROM labelled2",
    "label_parts":
        _w(SESSIONS, LABELLED) + "SELECT session_id, target_label AS predicted_label, "
        + ", ".join(f"string_split(target_label, '__')[{i + 1}] AS {n}" for i, n in enumerate(
            ["pred_risk_level", "pred_hr_zone", "pred_performance_level", "pred_event_type",
             "pred_hr_critical_flag"])) + " FROM labelled2",
    "label_codes":
        _w(SESSIONS, LABELLED) + "SELECT session_id, target_label, "
        "CAST(dense_rank() OVER (ORDER BY target_label) - 1 AS BIGINT) AS label_code FROM labelled2",
    "label_decode":
        _w(SESSIONS, LABELLED) + "SELECT session_id, CAST(dense_rank() OVER (ORDER BY target_label) - 1 AS BIGINT) "
        "AS code, target_label AS decoded FROM labelled2",
    "class_sizes":
        _w(SESSIONS, LABELLED) + "SELECT target_label, count(*) AS n FROM labelled2 GROUP BY target_label",
    "class_size_summary":
        _w(SESSIONS, LABELLED, "c AS (SELECT target_label, count(*) AS n FROM labelled2 GROUP BY 1)")
        + "SELECT count(*) AS n_classes, min(n) AS min_size, round(CAST(median(n) AS DOUBLE), 6) AS median_size, "
          "max(n) AS max_size FROM c",
    "label_nunique":
        _w(SESSIONS, LABELLED) + "SELECT " + ", ".join(
            f"count(DISTINCT {c}) AS {c}" for c in
            ["risk_level", "hr_zone", "performance_level", "event_type", "hr_critical_flag", "target_label"])
        + " FROM labelled2",
    "drop_singletons":
        "WITH p AS (SELECT p_partkey, coalesce(p_type, '?') || '__' || coalesce(CAST(p_size AS VARCHAR), '?') || '__' "
        "|| coalesce(p_brand, '?') AS target_label FROM part), "
        "v AS (SELECT target_label FROM p GROUP BY 1 HAVING count(*) >= 2) "
        "SELECT p_partkey, target_label FROM p WHERE target_label IN (SELECT target_label FROM v)",
    "build_lookup":
        _w(SESSIONS, LABELLED) + "SELECT target_label, arg_min(recommendation_entrainement, CASE WHEN "
        "recommendation_entrainement IS NOT NULL THEN session_id END) AS recommendation_entrainement "
        "FROM labelled2 GROUP BY target_label",
    "lookup_join":
        _w(SESSIONS, LABELLED,
           "lk AS (SELECT target_label, arg_min(recommendation_entrainement, CASE WHEN recommendation_entrainement "
           "IS NOT NULL THEN session_id END) AS txt FROM labelled2 GROUP BY 1)",
           "sc AS (SELECT session_id, risk_level || '__' || hr_zone || '__' || performance_level || '__' || event_type "
           "|| '__' || CASE WHEN injury_risk_score >= 0.75 THEN 'critical' ELSE 'normal' END AS predicted_label "
           "FROM labelled2)")
        + "SELECT session_id, predicted_label, CASE WHEN lk.target_label IS NULL THEN "
          "'(no recommendation text for label: ' || predicted_label || ')' ELSE lk.txt END AS pred_recommendation "
          "FROM sc LEFT JOIN lk ON sc.predicted_label = lk.target_label",
    "unseen_label":
        _w(SESSIONS, LABELLED,
           "k AS (SELECT DISTINCT target_label FROM labelled2 WHERE hr_critical_flag = 'normal')",
           "f AS (SELECT min(target_label) AS first_label FROM k)")
        + "SELECT session_id, target_label AS true_label, "
          "target_label NOT IN (SELECT target_label FROM k) AS is_unseen, "
          "CASE WHEN target_label IN (SELECT target_label FROM k) THEN target_label ELSE f.first_label END "
          "AS true_label_known FROM labelled2, f",
    "stratified_split":
        _w(SESSIONS, LABELLED,
           "r AS (SELECT session_id, target_label, CAST(row_number() OVER (PARTITION BY target_label ORDER BY "
           "md5(CAST(session_id AS VARCHAR) || '42'), session_id) AS BIGINT) AS rank_in_class FROM labelled2)",
           "sz AS (SELECT target_label, count(*) AS n_c FROM labelled2 GROUP BY 1)",
           "t1 AS (SELECT *, sum(n_c) OVER () AS n FROM sz)",
           "t2 AS (SELECT *, CAST(ceil(0.1 * n) AS BIGINT) AS n_test FROM t1)",
           "t3 AS (SELECT *, CAST(n_test AS DOUBLE) * n_c / n AS cont FROM t2)",
           "t4 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM t3)",
           "t5 AS (SELECT *, n_test - sum(fl) OVER () AS extra, "
           "row_number() OVER (ORDER BY rem DESC, target_label) AS pos FROM t4)",
           "q AS (SELECT target_label, CAST(fl + CASE WHEN pos <= extra THEN 1 ELSE 0 END AS BIGINT) AS quota FROM t5)")
        + "SELECT r.session_id, r.target_label, r.rank_in_class, r.rank_in_class <= q.quota AS is_test, "
          "CAST(CASE WHEN r.rank_in_class > q.quota THEN (r.rank_in_class - q.quota - 1) % 5 ELSE -1 END AS BIGINT) AS fold "
          "FROM r JOIN q ON r.target_label = q.target_label",
    "class_quotas":
        _w(SESSIONS, LABELLED,
           "sz AS (SELECT target_label, count(*) AS n_c FROM labelled2 GROUP BY 1)",
           "t1 AS (SELECT *, sum(n_c) OVER () AS n FROM sz)",
           "t2 AS (SELECT *, CAST(ceil(0.1 * n) AS BIGINT) AS n_test FROM t1)",
           "t3 AS (SELECT *, CAST(n_test AS DOUBLE) * n_c / n AS cont FROM t2)",
           "t4 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM t3)",
           "t5 AS (SELECT *, n_test - sum(fl) OVER () AS extra, "
           "row_number() OVER (ORDER BY rem DESC, target_label) AS pos FROM t4)")
        + "SELECT target_label, n_c, CAST(fl + CASE WHEN pos <= extra THEN 1 ELSE 0 END AS BIGINT) AS quota FROM t5",
    "class_weights":
        "WITH sz AS (SELECT label, count(*) AS n_c FROM embeddings GROUP BY 1), "
        "w AS (SELECT label, sum(n_c) OVER () / (count(*) OVER () * n_c) AS weight FROM sz) "
        "SELECT e.vec_id, CAST(e.label AS BIGINT) AS label, round(w.weight, 6) AS weight "
        "FROM embeddings e JOIN w ON e.label = w.label",
    "neighbour_count":
        "WITH sz AS (SELECT label, count(*) AS n_c FROM embeddings GROUP BY 1) "
        "SELECT min(n_c) AS min_class_size, least(CAST(5 AS BIGINT), min(n_c) - 1) AS k_neighbors FROM sz",
    "confusion_matrix":
        _w(SESSIONS, LABELLED, RULE) + "SELECT actual, predicted, count(*) AS n FROM rule GROUP BY 1, 2",
    "accuracy":
        _w(SESSIONS, LABELLED, RULE) + "SELECT round(avg(CAST(actual = predicted AS DOUBLE)), 6) AS accuracy FROM rule",
    "weighted_prf":
        _w(SESSIONS, LABELLED, RULE, PER_CLASS)
        + "SELECT round(sum(precision * support) / sum(support), 6) AS precision, "
          "round(sum(recall * support) / sum(support), 6) AS recall, "
          "round(sum(f1 * support) / sum(support), 6) AS f1, "
          "round(sum(recall * support) / sum(support), 6) AS accuracy FROM pc",
    "class_report":
        _w(SESSIONS, LABELLED, RULE, PER_CLASS)
        + "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support "
          "FROM pc UNION ALL "
          "SELECT 'accuracy', NULL, NULL, round(sum(recall * support) / sum(support), 6), CAST(sum(support) AS BIGINT) "
          "FROM pc UNION ALL "
          "SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), "
          "CAST(sum(support) AS BIGINT) FROM pc UNION ALL "
          "SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), "
          "round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), "
          "CAST(sum(support) AS BIGINT) FROM pc",
    "table_shape":
        _w(SESSIONS) + f"SELECT count(*) AS n_rows, CAST({len(SESSION_COLUMNS)} AS BIGINT) AS n_columns FROM sessions",
    "top3_classes":
        "WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS score, "
        "generate_subscripts(embedding, 1) - 1 AS class_index FROM embeddings), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_index DESC) AS rank FROM u) "
        "SELECT vec_id, CAST(rank AS BIGINT) AS rank, CAST(class_index AS BIGINT) AS class_index, "
        "round(score, 6) AS score FROM r WHERE rank <= 3",
    "top_features":
        _w(SESSIONS, _feature_spread())
        + "SELECT feature, round(weight, 6) AS weight, CAST(row_number() OVER (ORDER BY weight DESC, feature) AS BIGINT) "
          "AS rank FROM fs ORDER BY weight DESC, feature LIMIT 15",
    "feature_family":
        _w(SESSIONS, _feature_spread())
        + f"SELECT {_family('feature', TRAINING_RULES)} AS family, round(sum(weight), 6) AS weight, "
          "count(*) AS n_features FROM fs GROUP BY 1",
    "model_ranking": _model_ranking(),
    "performance_band":
        _w(SESSIONS) + "SELECT session_id, round(performance_score, 6) AS performance_score, CASE WHEN "
        "performance_score IS NULL THEN NULL WHEN performance_score >= 70 THEN 'excellent' WHEN performance_score >= 40 "
        "THEN 'moyen' ELSE 'insuffisant' END AS performance_band FROM sessions",
    "risk_band":
        _w(SESSIONS) + "SELECT session_id, round(injury_risk_score, 6) AS injury_risk_score, CASE WHEN "
        "injury_risk_score IS NULL THEN NULL WHEN injury_risk_score * 100 >= 80 THEN 'Critique' "
        "WHEN injury_risk_score * 100 >= 60 THEN 'Élevé' WHEN injury_risk_score * 100 >= 30 THEN 'Modéré' "
        "ELSE 'Faible' END AS risk_band FROM sessions",
    "gauge_value":
        _w(SESSIONS) + "SELECT session_id, round(CASE WHEN acceleration_mps2 IS NULL THEN NULL ELSE "
        "least(greatest(acceleration_mps2, 0.0), 100.0) END, 6) AS gauge_performance, "
        "round(least(greatest(injury_risk_score, 0.0), 1.0) * 100, 6) AS gauge_risk FROM sessions",
    "biometric_profile": _profile(),
    "high_risk":
        _w(SESSIONS) + "SELECT session_id, round(injury_risk_score, 6) AS injury_risk_score, "
        "coalesce(injury_risk_score > 0.6, false) AS high_risk FROM sessions",
    "recommendation_clauses":
        _clauses("(contains(upper(clause), 'ALERTE') OR contains(lower(clause), 'arrêt'))"),
    "injury_clauses":
        _clauses("(contains(upper(clause), 'ALERTE') OR contains(upper(clause), 'CRITIQUE') OR "
                 "contains(upper(clause), 'ARRÊT') OR contains(upper(clause), 'ARRET'))"),
    "preview":
        _w(SESSIONS) + "SELECT session_id, substring(coalesce(recommendation_entrainement, ''), 1, 80) || '…' "
        "AS preview, substring(coalesce(recommendation_entrainement, ''), 1, 90) || '…' AS preview_injury FROM sessions",
    "history_seq":
        _w(SESSIONS) + "SELECT athlete_id, session_id, CAST(row_number() OVER (PARTITION BY athlete_id ORDER BY "
        "\"timestamp\" ASC NULLS LAST, session_id ASC NULLS LAST) AS BIGINT) AS seq FROM sessions",
    "prediction_history":
        _w(SESSIONS, LABELLED) + "SELECT athlete_id, session_id, CAST(row_number() OVER (PARTITION BY athlete_id "
        "ORDER BY \"timestamp\" ASC NULLS LAST, session_id ASC NULLS LAST) AS BIGINT) AS seq, event_type AS event, "
        "risk_level AS risk, hr_zone, performance_level AS perf_level, round(performance_score, 6) AS "
        "performance_score, substring(coalesce(recommendation_entrainement, ''), 1, 80) || '…' AS recommendation "
        "FROM labelled2",
    "indicators":
        _w(SESSIONS) + "SELECT session_id, "
        "CAST(format('{:.1f}', coalesce(injury_risk_score, 0.0) * 100) AS DOUBLE) AS injury_risk_score_pct, "
        + ", ".join(f"CAST(format('{{:.2f}}', coalesce({c}, 0.0)) AS DOUBLE) AS {c}" for c in
                    ["heart_rate_bpm", "step_frequency_hz", "stride_length_m", "signal_energy"]) + " FROM sessions",
    "smote_balance":
        "WITH sz AS (SELECT label, count(*) AS n_c FROM embeddings GROUP BY 1) "
        "SELECT CAST(label AS BIGINT) AS label, max(n_c) OVER () AS n, max(n_c) OVER () - n_c AS synthetic FROM sz",
    "injury_label":
        _w(SESSIONS, LABELLED) + "SELECT session_id, risk_level || '__' || hr_zone || '__' || event_type AS target_label "
        "FROM labelled2",
    "injury_lookup":
        _w(SESSIONS, LABELLED, "il AS (SELECT *, risk_level || '__' || hr_zone || '__' || event_type AS lab FROM labelled2)")
        + "SELECT lab AS target_label, arg_min(recommendation_entrainement, CASE WHEN recommendation_entrainement "
          "IS NOT NULL THEN session_id END) AS recommendation_blessure FROM il GROUP BY lab",
    "injury_history":
        _w(SESSIONS, LABELLED) + "SELECT athlete_id, session_id, CAST(row_number() OVER (PARTITION BY athlete_id "
        "ORDER BY \"timestamp\" ASC NULLS LAST, session_id ASC NULLS LAST) AS BIGINT) AS seq, event_type AS event, "
        "risk_level AS risk, hr_zone, round(floor(injury_risk_score * 1000 + 0.5) / 10, 6) AS injury_risk_pct, "
        "substring(coalesce(recommendation_entrainement, ''), 1, 90) || '…' AS recommendation FROM labelled2",
    "confusion_wide":
        _w(SESSIONS, LABELLED, RULE) + "SELECT actual, "
        + ", ".join(f"CAST(sum(CASE WHEN predicted = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{v}\""
                    for v in ["Faible", "Modéré", "Élevé", "Critique"]) + " FROM rule GROUP BY actual",
    "drop_missing_target":
        _w(SESSIONS) + "SELECT session_id, athlete_id FROM sessions WHERE recommendation_entrainement IS NOT NULL",
    "csv_roundtrip":
        _w(SESSIONS) + "SELECT session_id, athlete_id, \"timestamp\", round(heart_rate_bpm, 6) AS heart_rate_bpm, "
        "round(signal_energy, 6) AS signal_energy, risk_level, recommendation_entrainement FROM sessions",
    "importance_scan":
        _w(SESSIONS, _feature_spread()) + "SELECT feature AS \"Feature\", round(weight, 6) AS \"Score\" FROM fs "
        "WHERE weight IS NOT NULL ORDER BY weight DESC, feature LIMIT 14",
    "metric_correlation":
        _w(SESSIONS) + " UNION ALL ".join(
            f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr({a}, {b}), 6) AS corr FROM sessions"
            for i, a in enumerate(["heart_rate_bpm", "performance_score", "step_frequency_hz", "stride_length_m",
                                   "signal_energy", "acceleration_mps2"])
            for b in ["heart_rate_bpm", "performance_score", "step_frequency_hz", "stride_length_m",
                      "signal_energy", "acceleration_mps2"][i + 1:]),
    "lookup_scan":
        _w(SESSIONS, LABELLED) + "SELECT target_label, arg_min(recommendation_entrainement, CASE WHEN "
        "recommendation_entrainement IS NOT NULL THEN session_id END) AS recommendation_entrainement "
        "FROM labelled2 GROUP BY target_label",
}
