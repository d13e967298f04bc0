"""Event-time lakehouse tables and data-preparation operators on PySpark."""

__version__ = "0.1.0"
