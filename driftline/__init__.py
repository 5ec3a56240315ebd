"""Driftline: period-over-period disclosure analytics as Spark DataFrame operators."""
