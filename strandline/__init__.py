"""Telemetry quality and alignment for fleets of irregular logs, on Spark DataFrames."""
