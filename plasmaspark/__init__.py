"""Spark-native fragmentomics engine: interval joins, feature tables and cohort baselines as DataFrame plans."""

__version__ = "0.1.0"
