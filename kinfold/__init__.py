"""Kinfold: record linkage and analytics as Spark DataFrame plans."""
