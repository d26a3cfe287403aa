"""Fixed vocabularies of the data contract."""

from __future__ import annotations

UNASSIGNED = "UNASSIGNED"

# The token sets that mean "not assigned to an entity".
CORE_TOKENS = ("UNASSIGNED", "Unassigned", "unassigned", "DROP", "drop", "nan", "NaN",
               "None", "", "0", "-1", "NA", "<NA>")
METRIC_TOKENS = ("UNASSIGNED", "Unassigned", "unassigned", "DROP", "nan", "None", "",
                 "0", "-1", "NA")
RECOVERY_TOKENS = ("UNASSIGNED", "-1", "0", "None", "nan", "<NA>", "")
FIGURE_TOKENS = CORE_TOKENS + ("background", "noise", "-1.0")
WINDOW_TOKENS = CORE_TOKENS + ("background",)
CONTEXT_SENTINELS = ("UNASSIGNED", "-1", "DROP", "nan", "None", "")

TOKEN_PRESETS = {
    "core": CORE_TOKENS,
    "metric": METRIC_TOKENS,
    "recovery": RECOVERY_TOKENS,
    "figure": FIGURE_TOKENS,
    "window": WINDOW_TOKENS,
    "context": CONTEXT_SENTINELS,
}

# Contract columns in their output order.
REQUIRED_COLUMNS = ("x", "y", "feature_name", "cell_id", "method")
OPTIONAL_COLUMNS = ("z", "transcript_id", "qv", "overlaps_nucleus", "original_cell_id",
                    "assignment_confidence", "cleaned_status", "whole_partial_status")

# Control-feature name prefixes, compared in lower case.
CONTROL_PREFIXES = ("blank", "negcontrol", "antisense", "deprecated", "control", "unassigned")

# Entity classes that count as assigned.
ASSIGNED_IN_STATS = ("cell", "partial")
ASSIGNED_IN_METRICS = ("cell", "partial", "component")


def tokens(preset_or_list) -> tuple[str, ...]:
    if isinstance(preset_or_list, str):
        return TOKEN_PRESETS[preset_or_list]
    return tuple(preset_or_list)
