"""logfold: command-log analytics, table profiling and log data preparation on PySpark."""

__version__ = "0.1.0"
