"""Operators for preparing training text: ten stand-alone steps and the queries that apply them to whole tables."""
