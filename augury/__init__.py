"""Forecast-validation analytics as Spark plans."""
