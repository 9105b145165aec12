"""Process mining on Spark: event logs as DataFrames, models as small driver objects."""

from .eventlog import EventLog

__all__ = ["EventLog"]
