"""walkloom: walk-forward signal analytics for panels of daily series on Spark."""

__version__ = "0.1.0"
