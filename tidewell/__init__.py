"""Change-data lakehouse analytics on PySpark."""

__version__ = "0.1.0"
