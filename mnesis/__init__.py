"""mnesis: long-term memory, recall and log processing as Spark DataFrame operators."""

__version__ = "0.1.0"
