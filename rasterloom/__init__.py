"""Spark-native discovery and evaluation of regions in rasters of feature vectors."""

__version__ = "0.1.0"
