"""Segment, conversation and network analytics as Spark DataFrame operators."""

from turnloom.session import get_spark

__all__ = ["get_spark"]
