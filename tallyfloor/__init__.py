"""Forecast floors for count panels, written as Spark DataFrame operators."""
