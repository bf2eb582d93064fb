"""Spark-native analytics for civic and environmental regulatory data."""

from regdata.session import build_session

__all__ = ["build_session"]
