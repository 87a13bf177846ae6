"""Governed document analytics as PySpark DataFrame programs."""
