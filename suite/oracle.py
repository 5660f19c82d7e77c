"""DuckDB SQL for the queries in ``queries.py``, built from shared parts."""

from __future__ import annotations

from rotaflow import fixed_values as V
from rotaflow.fixed_values import PARAMETERS
from rotaflow.sources.warehouse import APPLICATIONS
from suite.queries import PAUSE_MINUTES

ORDER = "ts, l_orderkey, l_linenumber, l_partkey"
WIN = f"(PARTITION BY well_id ORDER BY {ORDER})"


def r6(expression: str) -> str:
    return f"floor((({expression}) + 3.1e-9) * 1e6 + 5e-1) / 1e6"


def each(template: str, sep: str = ", ") -> str:
    return sep.join(template.replace("@", p) for p in PARAMETERS)


def frame(rows: int) -> str:
    return (
        f"(PARTITION BY well_id ORDER BY {ORDER} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    )


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _tolerance_values() -> str:
    rows = []
    for category, cells in V.TOLERANCES.items():
        for position, p in enumerate(PARAMETERS):
            mandatory, upper, lower, both = cells[p]
            number = lambda v: "NULL" if v is None else f"{v}e0"
            rows.append(
                f"('{category}', '{p}', {position}, {mandatory}, {number(upper)}, "
                f"{number(lower)}, {both})"
            )
    return ", ".join(rows)


_HITS = " || ".join(
    f"CASE WHEN {p}_hit THEN ['{p}'] ELSE []::VARCHAR[] END" for p in PARAMETERS
)
_DRIFT = "greatest(0, date_diff('day', DATE '1999-01-01', l_shipdate::DATE))"

PARTS = {
    "telemetry": f"""
        SELECT 'Well ' || l_suppkey AS well_id, l_shipdate AS ts,
               l_orderkey, l_linenumber, l_partkey,
               500 + 3e0 * (l_quantity - 25)
                   - CASE WHEN l_suppkey % 3 = 1 THEN 0.05e0 * {_DRIFT} ELSE 0e0 END AS flow,
               150 + 0.0002e0 * (l_extendedprice - l_quantity * 1500) + 150 * (l_tax - 0.04e0)
                   + CASE WHEN l_suppkey % 3 = 0 THEN 0.015e0 * {_DRIFT} ELSE 0e0 END AS head,
               25e0 AS suction,
               75 + 150 * (l_discount - 0.05e0) AS power,
               85 - 100 * (l_tax - 0.04e0) AS efficiency,
               1750e0 + l_linenumber AS speed
        FROM lineitem""",
    "numbered": f"""
        SELECT *, row_number() OVER {WIN} AS rn, count(*) OVER (PARTITION BY well_id) AS n,
               row_number() OVER (PARTITION BY well_id ORDER BY ts DESC, l_orderkey DESC,
                                  l_linenumber DESC, l_partkey DESC) AS back
        FROM telemetry""",
    "machines": f"""
        SELECT 'Well ' || s_suppkey AS well_id, 'Type ' || s_nationkey AS pump_type,
               abs(s_acctbal) % 268 AS horsepower,
               [{", ".join(text(a) for a in APPLICATIONS)}][s_nationkey % 6 + 1] AS application,
               500e0 AS baseline_flow, 150e0 AS baseline_head, 75e0 AS baseline_power,
               85e0 AS baseline_efficiency
        FROM supplier""",
    "early": f"""
        SELECT well_id, {each("median(@) AS baseline_@")}
        FROM numbered WHERE rn <= 168 GROUP BY well_id""",
    "registry": """
        SELECT *, CASE application
                WHEN 'Municipal Water and Wastewater' THEN '1U' WHEN 'API' THEN '1B'
                WHEN 'Energy Conservation' THEN '1E' WHEN 'Cooling Tower' THEN '2B'
                ELSE CASE WHEN horsepower < 134 THEN '3B' ELSE '2B' END END AS category
        FROM machines""",
    "tol": f"""
        SELECT * FROM (VALUES {_tolerance_values()})
            AS t(category, param, pos, mandatory, max_deviation, min_deviation, bidirectional)""",
    "wide": "SELECT category, "
    + each(
        "max(max_deviation) FILTER (param = '@') AS @_max, "
        "max(min_deviation) FILTER (param = '@') AS @_min, "
        "bool_or(mandatory) FILTER (param = '@') AS @_mandatory"
    )
    + " FROM tol GROUP BY category",
    "fleet": "SELECT * FROM registry JOIN wide USING (category)",
    "early_fleet": f"""
        SELECT r.* EXCLUDE ({each("baseline_@")}), e.* EXCLUDE (well_id), w.* EXCLUDE (category)
        FROM registry r JOIN early e USING (well_id) JOIN wide w USING (category)""",
    "dev": f"""
        SELECT *, {each("(@ - baseline_@) / baseline_@ * 100 AS @_deviation_pct")}
        FROM telemetry JOIN fleet USING (well_id)""",
    "early_dev": f"""
        SELECT *, {each("(@ - baseline_@) / baseline_@ * 100 AS @_deviation_pct")}
        FROM telemetry JOIN early_fleet USING (well_id)""",
}


def _status_parts(prefix: str, source: str) -> dict[str, str]:
    return {
        f"{prefix}flags": "SELECT *, "
        + each(
            "coalesce(@_deviation_pct > @_max, false) AS @_max_exceeded, "
            "coalesce(@_deviation_pct < @_min, false) AS @_min_exceeded, "
            "coalesce(@_deviation_pct > @_max, false) OR "
            "coalesce(@_deviation_pct < @_min, false) AS @_exceeded, "
            "CASE WHEN @_deviation_pct > @_max THEN abs(@_deviation_pct) / @_max "
            "WHEN @_deviation_pct < @_min THEN CASE WHEN @_min = 0 THEN abs(@_deviation_pct) / 10 "
            "ELSE abs(@_deviation_pct - @_min) / abs(@_min) END ELSE 0e0 END AS @_severity"
        )
        + f" FROM {source}",
        f"{prefix}counts": f"""
            SELECT *, row_number() OVER {WIN} AS reading_number,
                {each("(@_exceeded AND @_mandatory)::INT", " + ")} AS mand,
                {each("(@_exceeded AND @_severity >= 1.5)::INT", " + ")} AS severe,
                {each("@_exceeded::INT", " + ")} AS total,
                CASE {each("WHEN @_exceeded AND @_mandatory THEN '@'", " ")} END AS first_mandatory,
                {each("sum((@_deviation_pct > coalesce(@_max, 999))::INT) OVER "
                      + frame(24) + " AS @_often")}
            FROM {prefix}flags""",
        f"{prefix}status": f"""
            SELECT *, CASE WHEN total = 0 THEN 'Normal'
                WHEN mand >= 2 OR severe >= 2 THEN 'Failure'
                WHEN severe >= 1 OR total >= 3 THEN 'Critical'
                WHEN mand >= 1 AND sustained THEN 'Critical' ELSE 'Warning' END AS status
            FROM (SELECT *, reading_number >= 26 AND first_mandatory IS NOT NULL AND
                CASE first_mandatory {each("WHEN '@' THEN @_often", " ")} ELSE 0 END >= 16.8
                AS sustained FROM {prefix}counts)""",
    }


PARTS |= _status_parts("", "dev")
PARTS |= _status_parts("early_", "early_dev")
PARTS |= {
    "detail": " UNION ALL ".join(
        f"""SELECT well_id, '{p}' AS param, {i} AS pos, ts AS first_exceeded,
                baseline_{p} AS baseline, {p}_max AS max_deviation, {p}_min AS min_deviation,
                {p}_deviation_pct AS deviation
            FROM (SELECT *, row_number() OVER {WIN} AS k FROM flags WHERE {p}_exceeded) WHERE k = 1"""
        for i, p in enumerate(PARAMETERS)
    ),
    "failures": """
        SELECT 'Well ' || s_suppkey AS well_id,
               (DATE '2001-08-01' + (s_suppkey % 200)::INT)::TIMESTAMP AS failure_ts
        FROM supplier""",
    "sites": """
        SELECT 'Well ' || s_suppkey AS well_id, s_nationkey::BIGINT AS site_id,
               s_suppkey AS pump_id, s_suppkey * 10 AS sensor_base
        FROM supplier""",
    "labelled": """
        SELECT *, date_diff('microsecond', ts, failure_ts) / 86400000000e0 AS raw_days,
               greatest(0e0, date_diff('microsecond', ts, failure_ts) / 86400000000e0) AS rul
        FROM telemetry JOIN failures USING (well_id)""",
    "edge_dev": f"""
        SELECT *, {each("round_even((@ - baseline_@) / baseline_@ * 100 * 100, 0) / 100 + 0e0 AS @_dev")}
        FROM telemetry JOIN fleet USING (well_id)""",
    "edge_hit": "SELECT *, "
    + each(
        "CASE WHEN @_dev > @_max THEN @_max WHEN @_dev < @_min THEN @_min END AS @_limit, "
        "CASE WHEN @_dev > @_max THEN 'max' WHEN @_dev < @_min THEN 'min' END AS @_side, "
        "coalesce(@_dev > @_max, false) OR coalesce(@_dev < @_min, false) AS @_hit"
    )
    + " FROM edge_dev",
    "edge": f"""
        SELECT *, CASE WHEN mask = 0 THEN 'Normal' WHEN NOT mandatory_exceeded THEN 'Warning'
                WHEN worst / coalesce(nullif(lim, 0), 10) > 2 THEN 'Failure'
                WHEN worst / coalesce(nullif(lim, 0), 10) > 1.5 THEN 'Critical'
                ELSE 'Warning' END AS status
        FROM (SELECT *,
            {" + ".join(f"CASE WHEN {p}_hit THEN {1 << i} ELSE 0 END"
                        for i, p in enumerate(PARAMETERS))} AS mask,
            {each("(@_hit AND @_mandatory)", " OR ")} AS mandatory_exceeded,
            {_HITS} AS violated,
            greatest({each("CASE WHEN @_hit THEN abs(@_dev) ELSE 0 END")}) AS worst,
            greatest({each("CASE WHEN @_hit THEN abs(@_limit) ELSE 0 END")}) AS lim
            FROM edge_hit)""",
    "predicted": """
        SELECT *, round_even(rul * 100, 0) / 100 + 0e0 AS rul_days,
            CASE WHEN rul < 7 THEN 0.9e0 WHEN rul < 14 THEN 0.7e0 WHEN rul < 30 THEN 0.5e0
                 ELSE 0.3e0 END AS probability,
            round_even(greatest(0e0, least(1e0, 1 - rul / 30)) * 100, 0) / 100 + 0e0 AS confidence
        FROM (SELECT *, greatest(0e0, date_diff('microsecond', ts, failure_ts) / 86400000000e0)
                     AS rul FROM edge JOIN failures USING (well_id))""",
    "log": """
        SELECT event_id AS id, ts, user_id AS "pumpId", user_id % 10 AS "siteId",
               CASE WHEN k % 5 <> 4 THEN 101 + k % 5 END AS "sensorId", value AS "logValue",
               CASE event_type WHEN 'error' THEN 'Failure' WHEN 'purchase' THEN 'Critical'
                    WHEN 'view' THEN 'Warning' ELSE 'Normal' END AS status
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "vendor": """
        SELECT user_id::VARCHAR AS "SitePumpID", ts AS "PumpLogDate", value AS "OutputCurrent",
               100 + k / 2 AS "Pressure",
               CASE WHEN user_id % 7 = 0 THEN 0e0 ELSE k / 10 END AS "VibrationLevel",
               50 + k / 10 AS "Frequency", event_type <> 'signup' AS "Running",
               300e0 AS "PumpDepth", user_id::VARCHAR AS "PumpID",
               TIMESTAMP '2024-02-15 00:00:00' AS "FailTs"
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""",
    "running": 'SELECT * FROM vendor WHERE "Running"',
    "vendor_stats": """
        SELECT "SitePumpID", median("OutputCurrent") AS median_current,
               max("VibrationLevel") AS max_vibration FROM running GROUP BY 1""",
    "curve": """
        SELECT 'Well ' || l_suppkey AS site,
               CASE WHEN l_suppkey % 5 = 0 THEN l_quantity * 3 ELSE l_quantity * 10 END AS flow_gpm,
               l_extendedprice / 400 AS head_ft, l_extendedprice / 924 AS pressure_psi,
               20 + 50 * l_discount AS current_a
        FROM lineitem""",
    "stable": """
        SELECT * EXCLUDE (ok, any_ok) FROM (SELECT *, bool_or(ok) OVER (PARTITION BY site) AS any_ok
            FROM (SELECT *, flow_gpm > 200 AND head_ft > 50 AND head_ft < 200 AS ok FROM curve))
        WHERE CASE WHEN any_ok THEN ok ELSE flow_gpm > 0 END""",
    "dirty": """
        SELECT * REPLACE (CASE WHEN flow < 435 THEN -flow ELSE flow END AS flow,
            CASE WHEN head > 163 THEN NULL ELSE head END AS head,
            CASE WHEN power > 82 THEN 'nan'::DOUBLE ELSE power END AS power,
            CASE WHEN efficiency > 88.5 THEN efficiency + 20 ELSE efficiency END AS efficiency)
        FROM telemetry""",
    "current": f"""
        SELECT well_id, ts, status FROM (SELECT *, row_number() OVER (PARTITION BY well_id
            ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS back
            FROM status) WHERE back = 1""",
}

# slopes first, then features on top of them
_SLOPES = ", ".join(
    f"coalesce(({p}_deviation_pct - lag({p}_deviation_pct, {n}) OVER {WIN}) / {n}, 0) "
    f"AS {p}_slope_{n}h"
    for p in PARAMETERS
    for n in V.FEATURE_WINDOWS
)
PARTS["slopes"] = f"SELECT *, {_SLOPES} FROM dev"
_ROLLING = ", ".join(
    f"avg({p}_deviation_pct) OVER {frame(n)} AS {p}_rolling_mean_{n}h, "
    f"coalesce(stddev_samp({p}_deviation_pct) OVER {frame(n)}, 0) AS {p}_rolling_std_{n}h, "
    f"max({p}_deviation_pct) OVER {frame(n)} AS {p}_rolling_max_{n}h, "
    f"min({p}_deviation_pct) OVER {frame(n)} AS {p}_rolling_min_{n}h"
    for p in PARAMETERS
    for n in V.FEATURE_WINDOWS
)
_ACCELERATION = ", ".join(
    f"coalesce({p}_slope_{n}h - lag({p}_slope_{n}h) OVER {WIN}, 0) AS {p}_acceleration_{n}h"
    for p in PARAMETERS
    for n in V.FEATURE_WINDOWS
)
PARTS["features"] = f"""
    SELECT *, {_ROLLING}, {_ACCELERATION},
        {each("sum(@_deviation_pct) OVER (PARTITION BY well_id ORDER BY " + ORDER
              + " ROWS UNBOUNDED PRECEDING) AS @_cumulative_deviation")},
        {each("abs(@_deviation_pct) AS @_abs_deviation")},
        date_diff('microsecond', min(ts) OVER (PARTITION BY well_id), ts) / 3600000000e0
            AS hours_since_start,
        (isodow(ts) - 1)::DOUBLE AS day_of_week, hour(ts)::DOUBLE AS hour_of_day,
        flow_deviation_pct * head_deviation_pct AS flow_head_product,
        power_deviation_pct * efficiency_deviation_pct AS power_efficiency_product
    FROM slopes"""

PARTS["recent"] = f"""
    SELECT *, avg(flow) OVER {frame(24)} AS recent_flow_mean, row_number() OVER {WIN} AS number,
           count(*) OVER (PARTITION BY well_id) AS total FROM telemetry"""
PARTS["edge_lines"] = """
    SELECT well_id, count(*) AS readings, regr_intercept(rul, recent_flow_mean) AS intercept,
           regr_slope(rul, recent_flow_mean) AS slope
    FROM (SELECT *, greatest(0e0, date_diff('microsecond', ts, failure_ts) / 86400000000e0) AS rul
          FROM recent JOIN failures USING (well_id)
          WHERE number <= total - ceil(total * 0.2e0))
    GROUP BY well_id"""
PARTS["edge_predicted"] = """
    SELECT * EXCLUDE (raw), CASE WHEN raw IS NOT NULL THEN round_even(greatest(0e0, raw) * 100, 0) / 100 + 0e0 END AS rul_days,
        CASE WHEN raw < 7 THEN 0.9e0 WHEN raw < 14 THEN 0.7e0 WHEN raw < 30 THEN 0.5e0 WHEN raw IS NOT NULL THEN 0.3e0 END AS probability
    FROM (SELECT e.*, CASE WHEN r.number >= 40 THEN l.intercept + l.slope * r.recent_flow_mean END AS raw
          FROM edge e JOIN recent r USING (well_id, ts, l_orderkey, l_linenumber, l_partkey) LEFT JOIN edge_lines l USING (well_id))"""

NEEDS = {
    "recent": ["telemetry"],
    "edge_lines": ["recent", "failures"],
    "edge_predicted": ["edge", "recent", "edge_lines"],
    "numbered": ["telemetry"],
    "registry": ["machines"],
    "early": ["numbered"],
    "wide": ["tol"],
    "fleet": ["registry", "wide"],
    "early_fleet": ["registry", "early", "wide"],
    "dev": ["telemetry", "fleet"],
    "early_dev": ["telemetry", "early_fleet"],
    "flags": ["dev"],
    "counts": ["flags"],
    "status": ["counts"],
    "early_flags": ["early_dev"],
    "early_counts": ["early_flags"],
    "early_status": ["early_counts"],
    "detail": ["flags"],
    "labelled": ["telemetry", "failures"],
    "edge_dev": ["telemetry", "fleet"],
    "edge_hit": ["edge_dev"],
    "edge": ["edge_hit"],
    "predicted": ["edge", "failures"],
    "running": ["vendor"],
    "vendor_stats": ["running"],
    "stable": ["curve"],
    "dirty": ["telemetry"],
    "current": ["status"],
    "slopes": ["dev"],
    "features": ["slopes"],
}


def sql(final: str, *parts: str, recursive: str = "") -> str:
    """``final`` behind the named parts and everything they need, each once."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for part in parts:
        add(part)
    ctes = ", ".join(f"{name} AS ({PARTS[name].strip()})" for name in ordered)
    if recursive:
        return f"WITH RECURSIVE {ctes}, {recursive} {final}"
    return f"WITH {ctes} {final}" if ctes else final


ORACLE: dict[str, str] = {}


def oracle(name: str, final: str, *parts: str, recursive: str = "") -> None:
    ORACLE[name] = sql(final, *parts, recursive=recursive)


DEVS = each(f"{r6('@_deviation_pct')} AS @_deviation_pct")
SENSORS = ", ".join(
    f"{r6(c)} AS {c}" for c in ("flow", "head", "suction", "power", "efficiency", "speed")
)
BASELINES = each(f"{r6('baseline_@')} AS baseline_@")
ACTIONS = " ".join(
    f"WHEN '{s}' THEN {text('; '.join(actions))}" for s, (_, _, _, actions) in V.ADVICE.items()
)
WATCH = " ".join(
    f"WHEN '{s}' THEN {text('; '.join(watch))}" for s, (_, _, watch, _) in V.ADVICE.items()
)
LEVEL = " ".join(f"WHEN '{s}' THEN '{level}'" for s, (level, _, _, _) in V.ADVICE.items())
EVERY = " ".join(f"WHEN '{s}' THEN '{every}'" for s, (_, every, _, _) in V.ADVICE.items())
STATUS_COUNTS = ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in V.STATUSES
)
LOG = '"id", "ts", "pumpId", "siteId", "sensorId", "logValue", "status"'

# -- sources and sinks --------------------------------------------------------------
oracle(
    "read_baseline",
    f"SELECT well_id, pump_type, {r6('horsepower')} AS horsepower, application, {BASELINES} "
    "FROM machines",
    "machines",
)
oracle("read_telemetry", f"SELECT well_id, ts, {SENSORS} FROM telemetry", "telemetry")
oracle(
    "read_latest_feed",
    "SELECT well_id, count(*) AS readings, max(ts) AS newest_ts FROM telemetry GROUP BY well_id",
    "telemetry",
)
oracle(
    "read_vendor_log",
    """SELECT "SitePumpID", "PumpLogDate", "Running", "PumpID", "FailTs",
    """
    + ", ".join(
        f'{r6(chr(34) + c + chr(34))} AS "{c}"'
        for c in ("OutputCurrent", "Pressure", "VibrationLevel", "Frequency", "PumpDepth")
    )
    + " FROM vendor",
    "vendor",
)
CURVE = ", ".join(
    f"{r6(c)} AS {c}" for c in ("flow_gpm", "head_ft", "pressure_psi", "current_a")
)
oracle("read_curve_test", f"SELECT site, {CURVE} FROM curve", "curve")
oracle(
    "load_tolerances",
    f"""SELECT well_id, category, param, mandatory, max_deviation, min_deviation,
        CASE param {each("WHEN '@' THEN baseline_@", " ")} END AS baseline
    FROM registry JOIN tol USING (category)""",
    "registry",
    "tol",
)
oracle(
    "load_site_config",
    "SELECT site_id, pump_id, param, sensor_base + pos + 1 AS sensor_id FROM sites, "
    "(SELECT DISTINCT param, pos FROM tol)",
    "sites",
    "tol",
)
oracle(
    "pump_registry",
    f"""SELECT well_id, pump_type, {r6('horsepower')} AS horsepower, application, category,
        {BASELINES} FROM registry""",
    "registry",
)
oracle("read_anomaly_log", f"SELECT {LOG}, '1U' AS tolerance_category FROM log", "log")
oracle("write_processed", f"SELECT well_id, ts, {DEVS}, status FROM status", "status")
oracle(
    "write_anomaly_csv",
    """SELECT id, '{"status":"' || status || '"}' AS context FROM log""",
    "log",
)
oracle(
    "write_inference_result",
    f"""SELECT well_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, status,
        {each("@_dev")}, array_to_string(violated, ',') AS violated, false AS reported_to_api
    FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY ts DESC, l_orderkey DESC,
          l_linenumber DESC, l_partkey DESC) AS back FROM edge) WHERE back = 1""",
    "edge",
)
OUTBOX = """SELECT site_id AS "siteId", 'unsent' AS delivery_status, count(*) AS anomalies,
    max(ts) AS newest_ts FROM edge JOIN sites USING (well_id) WHERE mask > 0 GROUP BY 1"""
oracle("anomaly_outbox", OUTBOX, "edge", "sites")
oracle(
    "keyed_outbox",
    """SELECT site_id AS "siteId", CASE pump_id % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'unsent' END AS delivery_status,
        count(*) AS anomalies
    FROM (SELECT DISTINCT well_id, ts FROM edge WHERE mask > 0) JOIN sites USING (well_id) GROUP BY ALL""",
    "edge",
    "sites",
)
oracle("stream_outbox", OUTBOX, "edge", "sites")
ALERTS = """(SELECT well_id, string_agg('- ' || upper(param[1]) || param[2:] ||
    ': warn from ' || CASE WHEN a >= 0 THEN '+' ELSE '' END ||
    a::DECIMAL(9,1)::VARCHAR || '% on', chr(10) ORDER BY pos) AS alerts
    FROM (SELECT well_id, param, pos, coalesce(max_deviation / 2, min_deviation / 2) AS a
          FROM registry JOIN tol USING (category) WHERE mandatory) GROUP BY well_id)"""
oracle(
    "report_tables",
    f"""SELECT well_id, category, current.status AS current_status,
        CASE current.status {EVERY} END AS monitor_every,
        CASE current.status {ACTIONS} END AS actions, CASE current.status {WATCH} END AS watch,
        start_ts, end_ts, date_diff('day', start_ts, end_ts) AS days, alerts
    FROM fleet JOIN current USING (well_id) JOIN (SELECT well_id, min(ts) AS start_ts,
        max(ts) AS end_ts FROM telemetry GROUP BY well_id) USING (well_id)
    JOIN {ALERTS} USING (well_id)""",
    "fleet",
    "current",
)

# -- projections, filters, scalar rules -----------------------------------------------
oracle(
    "well_filter", f"SELECT well_id, ts, {SENSORS} FROM telemetry WHERE well_id = 'Well 3'",
    "telemetry",
)
oracle("running_filter", 'SELECT "SitePumpID", "PumpLogDate", "OutputCurrent" FROM running', "running")
oracle("stable_range_filter", f"SELECT site, {CURVE} FROM stable", "stable")
oracle("deviation_pct", f"SELECT well_id, ts, {DEVS} FROM dev", "dev")
oracle("deviation_pct_edge", f"SELECT well_id, ts, {each('@_dev')} FROM edge_dev", "edge_dev")
oracle(
    "tolerance_category",
    f"SELECT well_id, application, {r6('horsepower')} AS horsepower, category FROM registry",
    "registry",
)
oracle(
    "exceedance_flags",
    f"SELECT well_id, ts, {each('@_max_exceeded, @_min_exceeded, @_exceeded')} FROM flags",
    "flags",
)
oracle(
    "violation_map_edge",
    " UNION ALL ".join(
        f"""SELECT well_id, ts, '{p}' AS param, {p}_dev AS deviation, {p}_limit AS threshold,
            {p}_side AS threshold_type, {p}_mandatory AS mandatory FROM edge_hit WHERE {p}_hit"""
        for p in PARAMETERS
    ),
    "edge_hit",
)
oracle(
    "severity",
    f"SELECT well_id, ts, {each(r6('@_severity') + ' AS @_severity')} FROM flags",
    "flags",
)
oracle("classify_status", "SELECT well_id, ts, status, sustained FROM early_status", "early_status")
EDGE_STATUS = "SELECT well_id, ts, status, mandatory_exceeded FROM edge"
oracle("classify_status_edge", EDGE_STATUS, "edge")
oracle("stream_status", EDGE_STATUS, "edge")
BAND = " UNION ALL ".join(
    f"""SELECT well_id, '{p}' AS param, baseline_{p} AS baseline,
        CASE WHEN {p}_min IS NOT NULL THEN baseline_{p} * (1 + {p}_min / 100) ELSE 0e0 END AS lower,
        CASE WHEN {p}_max IS NOT NULL THEN baseline_{p} * (1 + {p}_max / 100)
             ELSE largest_{p} * 1.1e0 END AS upper
    FROM fleet JOIN (SELECT well_id, {each("max(@) AS largest_@")} FROM telemetry
                     GROUP BY well_id) USING (well_id)"""
    for p in PARAMETERS
)
oracle(
    "tolerance_band",
    f"SELECT well_id, param, {r6('baseline')} AS baseline, {r6('lower')} AS lower, "
    f"{r6('upper')} AS upper FROM ({BAND})",
    "telemetry",
    "fleet",
)
oracle(
    "band_excess",
    f"""SELECT well_id, ts, param, {r6('value')} AS value, {r6('baseline')} AS baseline,
        {r6('lower')} AS lower, {r6('upper')} AS upper, value > upper AS above_band,
        lower > 0 AND value < lower AS below_band, {r6('greatest(value, upper)')} AS clipped_up,
        {r6('least(value, lower)')} AS clipped_down
    FROM (SELECT well_id, ts, unnest({list(PARAMETERS)}) AS param,
                 unnest([{each("@")}]) AS value FROM telemetry)
    JOIN ({BAND}) USING (well_id, param)""",
    "telemetry",
    "fleet",
)
HP = "* 480e0 * sqrt(3e0) * 0.85e0 * 0.90e0 / 746e0"
EFF = ("CASE WHEN max_vibration > 0 THEN 75 + (1 - \"VibrationLevel\" / (max_vibration * 1.2e0)) * 15 "
       "ELSE 85e0 END")
oracle(
    "normalise_vendor_log",
    f"""SELECT 'Pump ' || "SitePumpID" AS well_id, "PumpLogDate" AS ts,
        {r6('500 * ("OutputCurrent" / median_current)')} AS flow, {r6('"Pressure"')} AS head,
        25e0 AS suction, {r6(f'"OutputCurrent" {HP}')} AS power, {r6(EFF)} AS efficiency,
        {r6('"Frequency" / 60 * 1800')} AS speed
    FROM running JOIN vendor_stats USING ("SitePumpID")""",
    "running",
    "vendor_stats",
)
oracle(
    "amps_to_hp",
    f"""SELECT "SitePumpID", "PumpLogDate", {r6(f'"OutputCurrent" {HP}')} AS power FROM vendor""",
    "vendor",
)
oracle(
    "hz_to_rpm",
    f"""SELECT "SitePumpID", "PumpLogDate", {r6('"Frequency" / 60 * 1800')} AS speed FROM vendor""",
    "vendor",
)
oracle(
    "flow_from_current",
    f"""SELECT "SitePumpID", "PumpLogDate", {r6('median_current')} AS median_current,
        {r6('500 * ("OutputCurrent" / median_current)')} AS flow
    FROM running JOIN vendor_stats USING ("SitePumpID")""",
    "running",
    "vendor_stats",
)
oracle(
    "eff_from_vibration",
    f"""SELECT "SitePumpID", "PumpLogDate", {r6('max_vibration')} AS max_vibration,
        {r6(EFF)} AS efficiency FROM running JOIN vendor_stats USING ("SitePumpID")""",
    "running",
    "vendor_stats",
)
oracle(
    "hydraulic_efficiency",
    f"""SELECT site, {r6('flow_gpm')} AS flow_gpm, {r6('head_ft')} AS head_ft,
        {r6('power')} AS power,
        {r6('greatest(60e0, least(95e0, flow_gpm * head_ft / 3960 / power * 100))')} AS efficiency,
        ceil(power / 0.85e0)::BIGINT AS rating
    FROM (SELECT *, current_a {HP} AS power FROM curve)""",
    "curve",
)
oracle(
    "abs_deviation",
    f"SELECT well_id, ts, {each(r6('abs(@_deviation_pct)') + ' AS @_abs_deviation')} FROM dev",
    "dev",
)
oracle(
    "interactions",
    f"""SELECT well_id, ts, {r6('flow_deviation_pct * head_deviation_pct')} AS flow_head_product,
        {r6('power_deviation_pct * efficiency_deviation_pct')} AS power_efficiency_product
    FROM dev""",
    "dev",
)
oracle("rul_labels", f"SELECT well_id, ts, {r6('rul')} AS rul_days FROM labelled", "labelled")
oracle(
    "fail_soon_labels",
    "SELECT well_id, ts, (raw_days <= 7)::BIGINT AS fails_soon FROM labelled",
    "labelled",
)
oracle(
    "feature_select",
    f"""SELECT well_id, '{",".join(f"{p}_deviation_pct" for p in PARAMETERS)}' AS features,
        {each(r6('sum(@_deviation_pct)') + ' AS @_deviation_pct_sum')} FROM dev GROUP BY well_id""",
    "dev",
)
oracle(
    "failure_probability",
    f"""SELECT well_id, ts, {r6('greatest(0e0, least(1e0, 1 - rul / 30))')} AS failure_probability
    FROM labelled""",
    "labelled",
)
oracle(
    "rul_buckets_edge",
    "SELECT well_id, ts, rul_days, probability, confidence FROM predicted",
    "predicted",
)
oracle(
    "early_warning_thresholds",
    """SELECT well_id, category, param, coalesce(max_deviation / 2, min_deviation / 2) AS alert_at
    FROM registry JOIN tol USING (category) WHERE mandatory""",
    "registry",
    "tol",
)
oracle(
    "recommendations",
    f"""SELECT well_id, ts, status, CASE status {LEVEL} END AS monitoring_level,
        CASE status {EVERY} END AS monitor_every, CASE status {WATCH} END AS watch,
        CASE status {ACTIONS} END AS actions FROM current""",
    "current",
)
oracle(
    "tolerance_summary",
    """SELECT well_id, category, string_agg(upper(param[1]) || param[2:] || ' (' ||
        CASE WHEN mandatory THEN 'mandatory' ELSE 'optional' END || '): ' ||
        CASE WHEN bidirectional THEN '+/- ' || max_deviation::INT || '%'
             WHEN max_deviation IS NOT NULL THEN '+' || max_deviation::INT || '%'
             WHEN min_deviation = 0 THEN '-0% (no negative deviation allowed)'
             ELSE min_deviation::INT || '%' END, '; ' ORDER BY pos) AS summary
    FROM registry JOIN tol USING (category) GROUP BY well_id, category""",
    "registry",
    "tol",
)
oracle("anomaly_timeline", f"SELECT well_id, ts, status, {DEVS} FROM status", "status")
NAMES = ", ".join(
    "({}, {}, {}, {})".format(*map(text, row))
    for row in (
        ("timestamp", "", "timestamp", "Timestamp"),
        ("Well ID", "", "Well ID", "Well Id"),
        ("Flow (gpm)", "gpm", "Flow", "Flow"),
        ("Discharge Pressure (psi)", "psi", "Discharge Pressure", "Discharge Pressure"),
        ("Suction Pressure (psi)", "psi", "Suction Pressure", "Suction Pressure"),
        ("Motor Power (hp)", "hp", "Motor Power", "Motor Power"),
        ("Pump Efficiency (%)", "%", "Pump Efficiency", "Pump Efficiency"),
        ("Motor Speed (rpm)", "rpm", "Motor Speed", "Motor Speed"),
    )
)
oracle(
    "name_helpers",
    f"""SELECT well_id, name, unit, label, title, lower(replace(well_id, ' ', '_')) AS slug
    FROM machines, (VALUES {NAMES}) AS n(name, unit, label, title)""",
    "machines",
)
oracle(
    "date_range_args",
    """SELECT id, "pumpId", ts, status FROM log
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'""",
    "log",
)
oracle(
    "status_code",
    """SELECT well_id, ts, status, CASE status WHEN 'Normal' THEN 0 WHEN 'Warning' THEN 1
        WHEN 'Critical' THEN 2 ELSE 3 END::BIGINT AS status_code FROM status""",
    "status",
)

# -- data quality -----------------------------------------------------------------------
oracle(
    "dq_required_columns", "SELECT well_id, count(*) AS readings FROM telemetry GROUP BY well_id",
    "telemetry",
)
oracle("dq_empty", "SELECT count(*) AS readings, count(*) = 0 AS empty FROM telemetry", "telemetry")


def failed(rule: str, column: str, level: str, condition: str, source: str) -> str:
    return (
        f"SELECT well_id, '{rule}' AS rule, '{column}' AS \"column\", '{level}' AS level, "
        f"count(*) AS readings FROM {source} WHERE {condition} GROUP BY well_id"
    )


DUPLICATES = """SELECT well_id, 'duplicate_timestamp' AS rule, 'ts' AS "column",
    'warning' AS level, count(*) - count(DISTINCT ts) AS readings
    FROM @ GROUP BY well_id HAVING count(*) > count(DISTINCT ts)"""
NEGATIVE = " UNION ALL ".join(
    failed("negative", c, "error", f"{c} < 0", "dirty") for c in ("flow", "head", "power", "speed")
)
RANGE = failed(
    "efficiency_range", "efficiency", "error", "efficiency < 0 OR efficiency > 100", "dirty"
)
MISSING = " UNION ALL ".join(
    failed("missing", c, "warning", f"{c} IS NULL OR isnan({c})", "dirty")
    for c in ("flow", "head", "suction", "power", "efficiency", "speed")
)
oracle("dq_duplicate_ts", DUPLICATES.replace("@", "telemetry"), "telemetry")
oracle(
    "dq_monotonic",
    failed(
        "not_chronological", "ts", "warning", "ts < before",
        """(SELECT *, lag(ts) OVER (PARTITION BY well_id
            ORDER BY l_orderkey, l_linenumber, l_partkey, ts) AS before FROM telemetry)""",
    ),
    "telemetry",
)
oracle("dq_negative", NEGATIVE, "dirty")
oracle("dq_efficiency_range", RANGE, "dirty")
oracle("dq_missing", MISSING, "dirty")
oracle(
    "dq_validate",
    " UNION ALL ".join([NEGATIVE, RANGE, MISSING, DUPLICATES.replace("@", "dirty")]),
    "dirty",
)
oracle(
    "dq_baseline",
    """SELECT well_id, 'horsepower must be positive' AS violation FROM registry
        WHERE horsepower < 20
    UNION ALL SELECT well_id, 'baseline_efficiency must be between 0 and 100' FROM registry
        WHERE category = '1E'
    UNION ALL SELECT well_id, 'several baselines for one machine' FROM registry
        WHERE length(well_id) = 6 AND horsepower >= 20 AND category <> '1E'""",
    "registry",
)
oracle(
    "dq_payload",
    """SELECT id, 'sourceType is missing' AS violation FROM log WHERE "pumpId" % 11 = 0
    UNION ALL SELECT id, 'sourceType is invalid' FROM log WHERE "pumpId" % 11 = 1
    UNION ALL SELECT id, 'description is missing' FROM log WHERE "pumpId" % 13 = 0
    UNION ALL SELECT id, 'pumpId is no integer' FROM log WHERE "pumpId" % 7 = 0
    UNION ALL SELECT id, 'timestamp is not ISO-8601' FROM log WHERE "pumpId" % 5 = 0
    UNION ALL SELECT id, 'logValue is not numeric' FROM log WHERE "pumpId" % 3 = 0""",
    "log",
)

# -- joins --------------------------------------------------------------------------------
oracle(
    "join_baseline",
    f"SELECT well_id, ts, {BASELINES} FROM telemetry JOIN early_fleet USING (well_id)",
    "telemetry",
    "early_fleet",
)
oracle(
    "unmatched_machines",
    """SELECT well_id, count(*) AS readings FROM telemetry
    WHERE well_id NOT IN (SELECT well_id FROM machines WHERE horsepower >= 50) GROUP BY well_id""",
    "telemetry",
    "machines",
)
oracle(
    "join_tolerance",
    f"SELECT well_id, category, {each('@_max, @_min, @_mandatory')} FROM fleet",
    "fleet",
)
oracle(
    "join_first_exceedance_value",
    f"SELECT well_id, param, {r6('deviation')} AS deviation FROM detail",
    "detail",
)
WORST = "list_position([{0}], list_max([{0}]))".format(
    each("CASE WHEN @_hit THEN abs(@_dev) ELSE -1 END")
)
oracle(
    "join_sensor",
    f"""SELECT sensor_base + w AS "sensorId", count(*) AS anomalies,
        {r6(f"avg([{each('@')}][w])")} AS mean_value
    FROM (SELECT *, {WORST} AS w FROM edge JOIN sites USING (well_id) WHERE mask > 0)
    GROUP BY 1""",
    "edge",
    "sites",
)
oracle(
    "join_failure_date",
    """SELECT well_id, max(ts) AS newest_ts, failure_ts
    FROM telemetry JOIN failures USING (well_id) GROUP BY well_id, failure_ts""",
    "telemetry",
    "failures",
)
oracle(
    "category_by_hp",
    f"""SELECT application, category, count(*) AS machines, {r6('max(horsepower)')} AS largest_hp
    FROM registry WHERE application IN ({", ".join(map(text, V.HORSEPOWER_APPLICATIONS))})
    GROUP BY application, category""",
    "registry",
)

# -- aggregations -----------------------------------------------------------------------------
oracle(
    "first_exceedance",
    f"""SELECT well_id, {each("min(ts) FILTER (@_exceeded) AS @_first_exceeded")}
    FROM flags GROUP BY well_id""",
    "flags",
)
oracle(
    "first_exceedance_detail",
    f"""SELECT well_id, param, first_exceeded, {r6('baseline')} AS baseline, max_deviation,
        min_deviation, {r6('deviation')} AS deviation FROM detail""",
    "detail",
)
oracle(
    "time_to_failure",
    """SELECT well_id, param, first_exceeded, failure_ts,
        floor(date_diff('microsecond', first_exceeded, failure_ts) / 86400000000e0)::BIGINT
            AS days_to_failure
    FROM detail JOIN failures USING (well_id)""",
    "detail",
    "failures",
)
oracle(
    "status_distribution",
    f"""SELECT well_id, s AS status, count(*) FILTER (status = s) AS readings,
        round(count(*) FILTER (status = s) * 100e0 / count(*), 1) AS pct
    FROM early_status, (SELECT unnest({list(V.STATUSES)}) AS s) GROUP BY well_id, s""",
    "early_status",
)
oracle(
    "fleet_status",
    f"""SELECT category, count(*) AS readings, count(DISTINCT well_id) AS machines, {STATUS_COUNTS}
    FROM early_status GROUP BY category""",
    "early_status",
)
oracle(
    "analysis_period",
    """SELECT well_id, min(ts) AS start_ts, max(ts) AS end_ts,
        date_diff('day', min(ts), max(ts)) AS days FROM telemetry GROUP BY well_id""",
    "telemetry",
)
oracle(
    "mean_deviation",
    f"SELECT well_id, {each(r6('avg(@_deviation_pct)') + ' AS @_mean_deviation')} "
    "FROM dev GROUP BY well_id",
    "dev",
)
oracle(
    "baseline_from_early",
    f"""SELECT well_id, 'Unknown' AS pump_type, 100e0 AS horsepower,
        'Municipal Water and Wastewater' AS application, {BASELINES} FROM early""",
    "early",
)
oracle(
    "baseline_from_curve_test",
    f"""SELECT site AS well_id, 'Unknown' AS pump_type, ceil(power / 0.85e0) AS horsepower,
        'Municipal Water and Wastewater' AS application, {r6('f')} AS baseline_flow,
        {r6('p')} AS baseline_head, {r6('power')} AS baseline_power,
        {r6('greatest(60e0, least(95e0, f * h / 3960 / power * 100))')} AS baseline_efficiency
    FROM (SELECT site, median(flow_gpm) AS f, median(head_ft) AS h, median(pressure_psi) AS p,
          median(current_a) {HP} AS power FROM stable GROUP BY site)""",
    "stable",
)
oracle(
    "source_summary",
    'SELECT "SitePumpID", count(*) AS records, '
    + ", ".join(
        f'{r6(f"avg({chr(34)}{c}{chr(34)})")} AS "{c}_mean", '
        f'{r6(f"min({chr(34)}{c}{chr(34)})")} AS "{c}_min", '
        f'{r6(f"max({chr(34)}{c}{chr(34)})")} AS "{c}_max"'
        for c in ("OutputCurrent", "Pressure", "VibrationLevel", "Frequency")
    )
    + ' FROM running GROUP BY "SitePumpID"',
    "running",
)
oracle(
    "curve_summary",
    "SELECT site, count(*) AS records, "
    + ", ".join(
        f"{r6(f'min({c})')} AS {c}_min, {r6(f'max({c})')} AS {c}_max"
        for c in ("flow_gpm", "head_ft", "pressure_psi", "current_a")
    )
    + " FROM curve GROUP BY site",
    "curve",
)
oracle(
    "label_stats",
    f"""SELECT well_id, {r6('min(rul)')} AS rul_min, {r6('max(rul)')} AS rul_max,
        sum((raw_days <= 7)::INT)::BIGINT AS positives,
        {r6('avg((raw_days <= 7)::INT) * 100')} AS positive_pct FROM labelled GROUP BY well_id""",
    "labelled",
)
oracle(
    "regression_metrics",
    f"""SELECT CASE WHEN rn > n - ceil(n * 0.2e0) THEN 'test' ELSE 'train' END AS part,
        count(*) AS readings, {r6('avg(abs(30 - rul))')} AS mae,
        {r6('sqrt(avg((30 - rul) * (30 - rul)))')} AS rmse,
        {r6('1 - avg((30 - rul) * (30 - rul)) / var_pop(rul)')} AS r2
    FROM (SELECT *, greatest(0e0, date_diff('microsecond', ts, failure_ts) / 86400000000e0) AS rul
          FROM numbered JOIN failures USING (well_id)) GROUP BY 1""",
    "numbered",
    "failures",
)
oracle(
    "anomaly_summary",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS dimension, {value} AS value, count(*) AS anomalies,
            min(ts) AS first_ts, max(ts) AS last_ts FROM log WHERE {value} IS NOT NULL GROUP BY 2"""
        for name, value in (
            ("by_status", "status"),
            ("by_pump", '"pumpId"::VARCHAR'),
            ("by_site", '"siteId"::VARCHAR'),
            ("by_sensor", '"sensorId"::VARCHAR'),
        )
    )
    + " UNION ALL SELECT 'total_anomalies', 'all', count(*), min(ts), max(ts) FROM log",
    "log",
)
oracle(
    "compare_pumps",
    f"""SELECT "pumpId", count(*) AS anomalies, {STATUS_COUNTS}, min(ts) AS first_ts,
        max(ts) AS last_ts FROM log GROUP BY 1""",
    "log",
)
oracle(
    "anomaly_timeline_pivot",
    f"SELECT ts::DATE AS date, {STATUS_COUNTS} FROM log GROUP BY 1",
    "log",
)
LATEST = each(
    f"{r6('avg(@)')} AS @_mean, {r6('stddev_samp(@)')} AS @_std, {r6('max(@)')} AS @_max, "
    f"{r6('min(@)')} AS @_min"
)
oracle(
    "latest_24_stats",
    f"SELECT well_id, count(*) AS readings, {LATEST} FROM numbered WHERE back <= 24 "
    "GROUP BY well_id",
    "numbered",
)
oracle(
    "stream_rolling_24",
    f"""SELECT well_id, max(ts) AS ts, count(*) AS readings, bool_and(n >= 600) AS ready, {LATEST}
    FROM numbered WHERE back <= 24 GROUP BY well_id""",
    "numbered",
)

# -- windows ----------------------------------------------------------------------------------


def feature_oracle(name: str, columns: list[str]) -> None:
    chosen = ", ".join(f"{r6(c)} AS {c}" for c in columns)
    oracle(name, f"SELECT well_id, ts, {chosen} FROM features", "features")


def _names(kind: str, stats=("",)) -> list[str]:
    return [
        f"{p}_{kind}_{stat}{n}h" for p in PARAMETERS for n in V.FEATURE_WINDOWS for stat in stats
    ]


ROLLING = _names("rolling", ("mean_", "std_", "max_", "min_"))
feature_oracle("rolling_stats", ROLLING)
feature_oracle("slope", _names("slope"))
feature_oracle("acceleration", _names("acceleration"))
_LONG = (f"(PARTITION BY well_id ORDER BY {ORDER} ROWS BETWEEN 479 PRECEDING AND CURRENT ROW)",
         "(PARTITION BY well_id ORDER BY epoch_us(ts) RANGE BETWEEN 2592000000000 PRECEDING AND CURRENT ROW)")
_STATISTICS = {"mean": "avg(#) OVER w", "std": "coalesce(stddev_samp(#) OVER w, 0e0)", "max": "max(#) OVER w", "min": "min(#) OVER w"}
oracle(
    "rolling_long",
    "SELECT well_id, ts, "
    + each(", ".join(f"{r6(e.replace('#', '@_deviation_pct'))} AS @_rolling_{s}_480h" for s, e in _STATISTICS.items()))
    + f" FROM dev WINDOW w AS {_LONG[0]}",
    "dev",
)
oracle(
    "rolling_time",
    "SELECT well_id, ts, count(*) OVER w AS readings, "
    + each(", ".join(f"{r6(e.replace('#', '@_deviation_pct'))} AS @_deviation_pct_{s}" for s, e in _STATISTICS.items()))
    + f" FROM dev WINDOW w AS {_LONG[1]}",
    "dev",
)
CUMULATIVE = [f"{p}_cumulative_deviation" for p in PARAMETERS]
feature_oracle("cumulative_deviation", CUMULATIVE)
feature_oracle("hours_since_start", ["hours_since_start"])
feature_oracle("time_features", ["day_of_week", "hour_of_day"])
ALL_FEATURES = [
    *[f"{p}_deviation_pct" for p in PARAMETERS],
    *ROLLING,
    *_names("slope"),
    *_names("acceleration"),
    *CUMULATIVE,
    *[f"{p}_abs_deviation" for p in PARAMETERS],
    "hours_since_start", "day_of_week", "hour_of_day", "flow_head_product",
    "power_efficiency_product",
]
feature_oracle("engineer_features", ALL_FEATURES)
TREND = "(@_deviation_pct - lag(@_deviation_pct, 24) OVER " + WIN + ") / 24"
oracle(
    "deviation_trend", f"SELECT well_id, ts, {each(r6(TREND) + ' AS @_trend')} FROM dev", "dev"
)
oracle(
    "sustained_violation",
    """SELECT well_id, ts, reading_number, first_mandatory, sustained FROM status
    WHERE first_mandatory IS NOT NULL""",
    "status",
)
oracle(
    "ffill",
    f"""SELECT well_id, ts, {r6('coalesce(last_value(f IGNORE NULLS) OVER w, 0)')} AS flow,
        {r6('coalesce(last_value(p IGNORE NULLS) OVER w, 0)')} AS power
    FROM (SELECT *, CASE WHEN flow < 530 THEN flow END AS f, CASE WHEN power > 78 THEN power END AS p
          FROM telemetry)
    WINDOW w AS (PARTITION BY well_id ORDER BY {ORDER}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "telemetry",
)
oracle(
    "chronological_split",
    """SELECT well_id, rn > n - ceil(n * 0.2e0) AS is_test, count(*) AS readings,
        min(ts) AS first_ts, max(ts) AS last_ts FROM numbered GROUP BY 1, 2""",
    "numbered",
)
oracle(
    "current_status",
    f"""SELECT well_id, ts, coalesce(status, '{V.NO_ANALYSIS}') AS status
    FROM machines LEFT JOIN current USING (well_id)""",
    "machines",
    "current",
)
oracle(
    "incremental_status",
    f"""SELECT s.well_id, s.ts, s.status, s.sustained, s.reading_number,
        {", ".join(f"{r6('f.' + c)} AS {c}" for c in (
            "flow_rolling_mean_168h", "head_slope_168h", "power_cumulative_deviation", "hours_since_start"))}
    FROM status s JOIN features f USING (well_id, ts, l_orderkey, l_linenumber, l_partkey)""",
    "status",
    "features",
)
oracle(
    "incremental_current_status",
    f"""SELECT well_id, ts, coalesce(status, '{V.NO_ANALYSIS}') AS status, {each("@_first_exceeded")}
    FROM machines LEFT JOIN current USING (well_id)
    LEFT JOIN (SELECT well_id, {each("min(ts) FILTER (@_exceeded) AS @_first_exceeded")} FROM flags GROUP BY well_id)
        USING (well_id)""",
    "machines",
    "current",
    "flags",
)
oracle(
    "status_episodes",
    f"""SELECT well_id, episode, any_value(status) AS status, min(ts) AS start_ts,
        max(ts) AS end_ts, count(*) AS readings,
        {r6("date_diff('microsecond', min(ts), max(ts)) / 3600000000e0")} AS hours
    FROM (SELECT *, sum(changed) OVER (PARTITION BY well_id ORDER BY {ORDER}
                                       ROWS UNBOUNDED PRECEDING)::BIGINT AS episode
          FROM (SELECT *, CASE WHEN lag(status) OVER {WIN} = status THEN 0 ELSE 1 END AS changed
                FROM status)) GROUP BY well_id, episode""",
    "status",
)

# -- order and top-k ------------------------------------------------------------------------------
oracle(
    "sort_by_time",
    "SELECT well_id, ts, l_orderkey AS order_key FROM telemetry ORDER BY ts, well_id, l_orderkey",
    "telemetry",
)
oracle(
    "latest_reading", f"SELECT well_id, ts, {SENSORS} FROM numbered WHERE back = 1", "numbered"
)
oracle(
    "first_n_per_pump",
    f"SELECT well_id, ts, {each(r6('@') + ' AS @')} FROM numbered WHERE rn <= 168",
    "numbered",
)
oracle(
    "exceedance_order",
    """SELECT well_id, param, first_exceeded,
        row_number() OVER (PARTITION BY well_id ORDER BY first_exceeded, pos) AS position
    FROM detail""",
    "detail",
)
FACTORS = [
    n
    for n in ALL_FEATURES
    if "24h" not in n and "168h" not in n and "cumulative" not in n and n != "hours_since_start"
]
oracle(
    "contributing_factors",
    "SELECT well_id, ts, array_to_string(list_transform(list_sort(["
    + ", ".join(f"{{'w': -abs({n}), 'name': '{n}'}}" for n in FACTORS)
    + "])[1:5], lambda e: e.name), ',') AS factors FROM features",
    "features",
)
oracle(
    "anomaly_page",
    f"""SELECT {LOG} FROM log WHERE "siteId" = 4 ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 50""",
    "log",
)
oracle(
    "anomaly_page_keyset",
    f"""SELECT {LOG} FROM log WHERE (ts, id) > (TIMESTAMP '2024-01-15', 0)
    ORDER BY ts, id LIMIT 40""",
    "log",
)
oracle(
    "anomaly_page_total",
    """SELECT count(*) AS total, 50::BIGINT AS skip, 25::BIGINT AS take FROM log
    WHERE "siteId" = 4""",
    "log",
)
oracle(
    "anomaly_query",
    f"""SELECT {LOG} FROM log WHERE ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31'
    ORDER BY ts DESC, id DESC LIMIT 1000""",
    "log",
)
oracle(
    "result_retention",
    """SELECT "siteId", count(*) AS anomalies, min(ts) AS oldest_ts FROM log
    WHERE ts >= TIMESTAMP '2024-01-17' GROUP BY 1""",
    "log",
)
ORACLE["retention_store"] = ORACLE["result_retention"]
oracle(
    "anomaly_page_deep",
    f"SELECT {LOG} FROM log ORDER BY ts DESC, id DESC LIMIT 30 OFFSET 400",
    "log",
)
oracle(
    "union_readings",
    """SELECT well_id, count(*) AS readings, round(sum(flow), 4) + 0e0 AS flow_sum
    FROM telemetry GROUP BY well_id""",
    "telemetry",
)

# -- anomaly records ------------------------------------------------------------------------------
VIOLATION_TEXT = " || ".join(
    f"CASE WHEN {p}_hit THEN ['{p}: ' || round({p}_dev::DECIMAL(18,2), 1)::VARCHAR || "
    f"'% (threshold: ' || {p}_limit::DECIMAL(18,1)::VARCHAR || '%)'] ELSE []::VARCHAR[] END"
    for p in PARAMETERS
)
oracle(
    "anomaly_payload",
    f"""SELECT well_id, 'log' AS "sourceType",
        'Pump anomaly detected - ' || array_to_string({VIOLATION_TEXT}, ', ') AS description,
        site_id AS "siteId", pump_id AS "pumpId", sensor_base + w AS "sensorId",
        strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
        {r6(f"[{each('@')}][w]")} AS "logValue", array_to_string(violated, ',') AS parameter,
        status, category AS tolerance_category, {r6('flow')} AS current_flow,
        'pump-anomaly-detector' AS "modelName", rul_days AS prediction_rul_days,
        probability AS prediction_probability, confidence
    FROM (SELECT *, {WORST} AS w FROM predicted JOIN sites USING (well_id) WHERE mask > 0)""",
    "predicted",
    "sites",
)
oracle(
    "simple_payload",
    f"""SELECT 'log' AS "sourceType", 'Status ' || status AS description, site_id AS "siteId",
        pump_id AS "pumpId", strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, status,
        category AS tolerance_category, flow_dev, {r6('baseline_head')} AS baseline_head
    FROM edge JOIN sites USING (well_id) WHERE mask > 0""",
    "edge",
    "sites",
)

# -- debouncing: one recursion step per alarm of a machine ------------------------------------------
_PAUSE = PAUSE_MINUTES * 60_000_000


def debounce_parts(bypass: bool, reset: bool) -> str:
    hit = lambda p: f"a.mask & {1 << PARAMETERS.index(p)} > 0"
    known = lambda p: f"CASE WHEN a.after_normal THEN NULL ELSE s.{p} END" if reset else f"s.{p}"
    level = "CASE WHEN a.after_normal THEN 0 ELSE s.lvl END" if reset else "s.lvl"
    near = lambda p: f"{hit(p)} AND a.tick - ({known(p)}) < {_PAUSE}"
    free = f"a.level > ({level})" if bypass else "false"
    blocked = (
        f"CASE WHEN {free} THEN NULL "
        + " ".join(f"WHEN {near(p)} THEN '{p}'" for p in PARAMETERS)
        + " END"
    )
    elapsed = (
        f"CASE WHEN {free} THEN NULL "
        + " ".join(f"WHEN {near(p)} THEN (a.tick - ({known(p)})) / 60000000e0" for p in PARAMETERS)
        + " END"
    )
    stamps = ", ".join(
        f"CASE WHEN ({blocked}) IS NULL AND {hit(p)} THEN a.tick ELSE {known(p)} END"
        for p in PARAMETERS
    )
    start = ", ".join(f"CASE WHEN {hit(p)} THEN a.tick END AS {p}" for p in PARAMETERS)
    return f"""
    ordered AS (SELECT *, epoch_us(ts) AS tick,
        CASE status WHEN 'Normal' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Critical' THEN 2 ELSE 3 END
            AS level,
        coalesce(lag(mask) OVER {WIN} = 0, false) AS after_normal FROM edge),
    alarms AS (SELECT well_id, ts, tick, mask, level, after_normal,
        row_number() OVER {WIN} AS k FROM ordered WHERE mask > 0),
    decided AS (
        SELECT a.well_id, a.k, a.ts, a.mask, NULL::VARCHAR AS blocked_by,
               NULL::DOUBLE AS elapsed_minutes, {start}, a.level AS lvl
        FROM alarms a WHERE a.k = 1
        UNION ALL
        SELECT a.well_id, a.k, a.ts, a.mask, {blocked}, {elapsed}, {stamps},
               CASE WHEN ({blocked}) IS NULL THEN a.level ELSE {level} END
        FROM decided s JOIN alarms a ON a.well_id = s.well_id AND a.k = s.k + 1)"""


DECIDED = "SELECT well_id, ts, mask::BIGINT AS mask, blocked_by, elapsed_minutes FROM decided"
oracle("debounce_anomalies", DECIDED, "edge", recursive=debounce_parts(False, False))
oracle("debounce_documented", DECIDED, "edge", recursive=debounce_parts(True, True))
oracle("stream_debounce", DECIDED, "edge", recursive=debounce_parts(False, False))
oracle(
    "report_decision",
    """SELECT p.well_id, p.ts, p.status, p.status <> 'Normal' AND d.blocked_by IS NULL AS report,
        CASE WHEN p.status = 'Normal' THEN 'Status is Normal'
             WHEN d.blocked_by IS NOT NULL THEN 'Recently reported ' || d.blocked_by ||
                ' anomaly (' || d.elapsed_minutes::DECIMAL(18,1)::VARCHAR || ' min ago)'
             WHEN p.mandatory_exceeded THEN 'Mandatory parameter exceeded'
             WHEN p.status IN ('Critical', 'Failure') THEN 'Status is ' || p.status
             WHEN p.probability > 0.7 AND p.rul_days < 7 THEN 'High confidence failure prediction'
             ELSE 'Warning status' END AS reason
    FROM (SELECT *, CASE WHEN mask > 0 THEN row_number() OVER (PARTITION BY well_id, mask > 0
            ORDER BY ts, l_orderkey, l_linenumber, l_partkey) END AS k FROM predicted) p
    LEFT JOIN decided d ON d.well_id = p.well_id AND d.k = p.k""",
    "predicted",
    recursive=debounce_parts(False, False),
)
oracle(
    "machine_model",
    "SELECT well_id, readings, round(intercept, 4) + 0e0 AS intercept, round(slope, 4) + 0e0 AS slope FROM edge_lines",
    "edge_lines",
)
for _name in ("edge_run", "stream_edge_run"):
    oracle(
        _name,
        f"""SELECT well_id, ts, 'Pump anomaly detected - ' || array_to_string({VIOLATION_TEXT}, ', ') AS description,
            sensor_base + w AS "sensorId",
            CASE WHEN mandatory_exceeded THEN 'Mandatory parameter exceeded'
                 WHEN status IN ('Critical', 'Failure') THEN 'Status is ' || status
                 WHEN probability > 0.7 AND rul_days < 7 THEN 'High confidence failure prediction'
                 ELSE 'Warning status' END AS reason,
            {r6(f"[{each('@')}][w]")} AS "logValue", status,
            CASE WHEN rul_days IS NULL THEN '1.0.0' ELSE '2.0' END AS "modelVersion",
            CASE WHEN rul_days IS NOT NULL THEN 'linear' END AS model_type,
            rul_days AS prediction_rul_days, probability AS prediction_probability
        FROM (SELECT p.*, sensor_base, {WORST} AS w
              FROM (SELECT *, row_number() OVER {WIN} AS k FROM edge_predicted WHERE mask > 0) p
              JOIN decided d ON d.well_id = p.well_id AND d.k = p.k JOIN sites ON sites.well_id = p.well_id
              WHERE d.blocked_by IS NULL)""",
        "edge_predicted",
        "sites",
        recursive=debounce_parts(False, False),
    )
oracle(
    "ml_gate",
    "SELECT well_id, count(*) AS readings, count(*) >= 600 AS ready FROM telemetry GROUP BY well_id",
    "telemetry",
)
oracle(
    "stream_dedup",
    f"SELECT well_id, ts, {', '.join(PARAMETERS)} FROM telemetry",
    "telemetry",
)
oracle(
    "scale_features",
    "SELECT well_id, ts, "
    + each(
        r6(
            "CASE WHEN stddev_pop(@_deviation_pct) OVER w > 0 THEN (@_deviation_pct - "
            "avg(@_deviation_pct) OVER w) / stddev_pop(@_deviation_pct) OVER w ELSE 0 END"
        )
        + " AS @_deviation_pct"
    )
    + " FROM dev WINDOW w AS (PARTITION BY well_id)",
    "dev",
)
