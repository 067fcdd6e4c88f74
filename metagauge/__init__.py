"""Health analytics of data-lake tables from their metadata, on Spark."""

from .analyzer import TableAnalyzer

__all__ = ["TableAnalyzer"]
