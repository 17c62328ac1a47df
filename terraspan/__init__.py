"""Terraspan: a Spark-native analytics engine for Earth-observation archives."""

__version__ = "0.1.0"
