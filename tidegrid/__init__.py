"""Sensor time-series analytics as PySpark DataFrame operators."""

from tidegrid.plans.series import Series
from tidegrid.session import get_session

__all__ = ["Series", "get_session"]
