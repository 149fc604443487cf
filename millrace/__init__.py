"""PySpark-native analytics over knowledge tables: retrieval, graph, facts, time series, evaluation."""

from millrace.session import get_session

__all__ = ["get_session"]
