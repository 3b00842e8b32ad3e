"""Collision-event analytics as Spark DataFrame operators."""
