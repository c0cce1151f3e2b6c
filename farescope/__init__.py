"""Fare and inventory snapshot analytics as PySpark DataFrame operators."""
