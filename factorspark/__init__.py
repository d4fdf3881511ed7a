"""Equity factor research and portfolio evaluation as lazy Spark DataFrame operators."""
