"""Sources and sinks: trip tables, request tables, artifacts (stats, comparison, models, runs)."""
