"""Tidemark: layered tables, strict pipelines and text operators on stock PySpark."""
