"""Spark-native analytics over operational telemetry: event logs, series and job histories."""
