"""Tidemark: DataFrame operators for ordered tick and event streams on Apache Spark."""
