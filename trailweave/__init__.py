"""Trailweave: a PySpark-native engine for path, graph, text and corpus workloads."""

__version__ = "0.1.0"
