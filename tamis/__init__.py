"""Spark-native parsing of semi-structured documents, unit normalisation and data-quality checks."""
