"""Values fixed by the monitoring rules; results depend on them exactly."""

from __future__ import annotations

# --- fixed values: parameters and the column names of telemetry files ------
PARAMETERS = ("flow", "head", "power", "efficiency")

TELEMETRY_COLUMNS = {
    "timestamp": "ts",
    "Well ID": "well_id",
    "Flow (gpm)": "flow",
    "Discharge Pressure (psi)": "head",
    "Suction Pressure (psi)": "suction",
    "Motor Power (hp)": "power",
    "Pump Efficiency (%)": "efficiency",
    "Motor Speed (rpm)": "speed",
}

BASELINE_COLUMNS = {
    "Well ID": "well_id",
    "pump_type": "pump_type",
    "horsepower": "horsepower",
    "application": "application",
    "baseline_flow_gpm": "baseline_flow",
    "baseline_discharge_pressure_psi": "baseline_head",
    "baseline_power_hp": "baseline_power",
    "baseline_efficiency_percent": "baseline_efficiency",
}

# --- fixed values: statuses, in order of severity --------------------------
STATUSES = ("Normal", "Warning", "Critical", "Failure")
NO_ANALYSIS = "Unknown (No analysis performed)"

# --- fixed values: tolerance categories ------------------------------------
# category -> parameter -> (mandatory, upper limit %, lower limit %, both sides)
# None = the side has no limit; configuration files write 999 / -999 for that.
NO_UPPER_LIMIT = 999.0
NO_LOWER_LIMIT = -999.0

TOLERANCES = {
    "1B": {
        "flow": (True, 5.0, -5.0, True),
        "head": (True, 3.0, -3.0, True),
        "power": (False, 4.0, None, False),
        "efficiency": (False, None, -3.0, False),
    },
    "1E": {
        "flow": (True, 5.0, -5.0, True),
        "head": (True, 3.0, -3.0, True),
        "power": (False, 4.0, None, False),
        "efficiency": (False, None, 0.0, False),
    },
    "1U": {
        "flow": (True, 10.0, None, False),
        "head": (True, 6.0, None, False),
        "power": (False, 10.0, None, False),
        "efficiency": (False, None, 0.0, False),
    },
    "2B": {
        "flow": (True, 8.0, -8.0, True),
        "head": (True, 5.0, -5.0, True),
        "power": (False, 8.0, None, False),
        "efficiency": (False, None, -5.0, False),
    },
    "2U": {
        "flow": (True, 16.0, None, False),
        "head": (True, 10.0, None, False),
        "power": (False, 16.0, None, False),
        "efficiency": (False, None, -5.0, False),
    },
    "3B": {
        "flow": (True, 9.0, -9.0, True),
        "head": (True, 7.0, -7.0, True),
        "power": (False, 9.0, None, False),
        "efficiency": (False, None, -7.0, False),
    },
}

# --- fixed values: application -> category ---------------------------------
APPLICATION_CATEGORY = {
    "Municipal Water and Wastewater": "1U",
    "API": "1B",
    "Energy Conservation": "1E",
    "Cooling Tower": "2B",
}
HORSEPOWER_APPLICATIONS = ("General Industry", "Dewatering, drainage, and irrigation")
HORSEPOWER_SPLIT = 134.0
BELOW_SPLIT_CATEGORY = "3B"
FROM_SPLIT_CATEGORY = "2B"

# --- fixed values: classification rules ------------------------------------
SEVERE_FROM = 1.5
ZERO_LIMIT_SCALE = 10.0
HISTORY_WINDOW = 24
SUSTAINED_SHARE = 0.7
FIRST_SUSTAINED_ROW = 26  # 1-based row number from which history is looked at
EDGE_FAILURE_ABOVE = 2.0
EDGE_CRITICAL_ABOVE = 1.5

# --- fixed values: features, labels, predictions ---------------------------
FEATURE_WINDOWS = (24, 168)
EARLY_ROWS = 168
SOON_DAYS = 7
RUL_HORIZON_DAYS = 30.0
RUL_BUCKETS = ((7.0, 0.9), (14.0, 0.7), (30.0, 0.5))
RUL_BEYOND = 0.3

# --- fixed values: vendor and curve-test conversions -----------------------
VOLTAGE = 480.0
POWER_FACTOR = 0.85
MOTOR_EFFICIENCY = 0.90
WATTS_PER_HP = 746.0
NOMINAL_FLOW = 500.0
NOMINAL_SUCTION = 25.0
DEFAULT_EFFICIENCY = 85.0
HYDRAULIC_CONSTANT = 3960.0
EFFICIENCY_CLAMP = (60.0, 95.0)
TYPICAL_LOADING = 0.85

CURVE_TEST_COLUMNS = {
    "4 Line Current Flow (gal/min)": "flow_gpm",
    "4 Line FT Head (ft)": "head_ft",
    "4 Line Pressure (psi)": "pressure_psi",
    "Power Monitor A Current Average (A)": "current_a",
}

# --- fixed values: anomaly reporting ---------------------------------------
DEBOUNCE_MINUTES = 60
MIN_READINGS_FOR_ML = 168
RETENTION_DAYS = 30
REPORT_PROBABILITY_ABOVE = 0.7
REPORT_RUL_BELOW = 7.0
SOURCE_TYPES = ("log", "vision")
DESCRIPTION_PREFIX = "Pump anomaly detected - "
REASONS = {
    "normal": "Status is Normal",
    "debounced": "Recently reported %s anomaly (%.1f min ago)",
    "mandatory": "Mandatory parameter exceeded",
    "status": "Status is ",
    "prediction": "High confidence failure prediction",
    "warning": "Warning status",
    "none": "No reporting criteria met",
}
MODEL_NAME = "pump-anomaly-detector"
MODEL_VERSION = "1.0.0"
FRAMEWORK = "spark-ml"

# --- fixed values: advice by current status --------------------------------
ADVICE = {
    "Normal": (
        "Normal",
        "daily",
        ("Continue routine monitoring",),
        ("Continue scheduled maintenance", "No immediate action required"),
    ),
    "Warning": (
        "Warning",
        "every 4 hours",
        ("Watch for trend toward Critical status",),
        (
            "Schedule inspection within 1 week",
            "Check for wear, alignment, and seal condition",
            "Review recent operational changes",
        ),
    ),
    "Critical": (
        "Critical",
        "hourly",
        ("Increase monitoring frequency to detect rapid changes",),
        (
            "Schedule inspection **immediately**",
            "Prepare for potential pump replacement",
            "Investigate root cause of degradation",
        ),
    ),
    "Failure": (
        "Critical",
        "hourly",
        ("Increase monitoring frequency to detect rapid changes",),
        (
            "**IMMEDIATE ACTION REQUIRED**",
            "Pump replacement or major repair needed",
            "Conduct failure analysis",
        ),
    ),
}
