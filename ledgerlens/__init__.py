"""A Spark-native evidence and context engine: a typed record log, heads, search, graphs, provenance, triggers and renders."""

__version__ = "0.1.0"
