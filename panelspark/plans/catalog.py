"""Importing this module registers every query."""

from . import index_queries, model_queries, stream_queries, text_queries  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
