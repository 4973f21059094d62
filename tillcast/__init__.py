"""tillcast: retail sales analytics and forecasting as Spark jobs."""

__version__ = "0.1.0"
