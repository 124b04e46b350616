"""Tessera: a Spark-native engine for ranked entity mapping, set clustering and corpus work."""

__version__ = "0.1.0"
