"""Foliograph: a Spark-native engine for turning technical manuals into searchable, auditable tables."""
