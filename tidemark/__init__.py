"""Event-study analytics on Spark: point-in-time joins, features, outcomes and statistics."""

__version__ = "0.1.0"
