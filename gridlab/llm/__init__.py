"""Operators of a training-data pipeline (see the package README section)."""
