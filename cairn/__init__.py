"""cairn: a Spark-first analytics engine for code bases and document collections."""

__version__ = "0.1.0"
