"""threadloom: a Spark-native engine for branching conversation archives."""

__version__ = "0.1.0"
