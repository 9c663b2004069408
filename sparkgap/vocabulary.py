"""Words that stored data and results must use."""

# The states, classes and other words of stored assignments.
NET_CLASSES = (
    "GND", "POWER", "POWER_NEGATIVE", "POWER_VARIABLE", "POWER_HIGHER_LOW_VOLTAGE", "HIGH_VOLTAGE", "MAINS", "BATTERY", "IO_DIGITAL",
    "IO_ANALOG", "DIFFERENTIAL_IO", "COMMUNICATION", "ISOLATION_DOMAIN_HINT", "CONTROL_SIGNAL", "REFERENCE", "UNKNOWN",
)
CONFIDENCES = ("High", "Medium", "Low", "Unknown")
SEVERITIES = ("Info", "Review", "Warning", "Critical")
REVIEW_STATES = (
    "Auto-guessed", "Imported", "Needs review", "Reviewed", "Approved", "Accepted unknown", "Waived", "Conflict",
    "Obsolete / missing in new revision",
)
SOURCES = ("rule", "manual", "imported_exact", "imported_case_insensitive", "imported_normalized", "imported_manual_mapping", "unknown")
VOLTAGE_TYPES = ("DC", "AC_RMS", "AC_PEAK", "VARIABLE", "UNKNOWN")
MATCH_TYPES = ("exact", "token", "prefix", "suffix", "regex")
ASSIGNMENT_COLUMNS = (
    "net_name", "final_class", "final_voltage_v", "reference_net", "voltage_type", "confidence", "severity", "review_state", "source",
    "galvanic_zone", "notes",
)
GROUND_NAMES = ("0", "0V", "GND", "GROUND", "AGND", "DGND", "PGND", "SGND")
NO_NET = "$NONE$"
