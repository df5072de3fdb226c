"""Ready-made queries over the telemetry tables, composed from the operators."""
