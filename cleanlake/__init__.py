"""Web content sanitization, threat analytics and training-data preparation on Spark."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
