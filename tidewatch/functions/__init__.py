"""Functions of the telemetry engine."""
