"""Headline-stance and event-panel analytics as PySpark DataFrame operators."""
