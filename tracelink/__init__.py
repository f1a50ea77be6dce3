"""Operator-attribution analytics as Spark DataFrame transformations."""
