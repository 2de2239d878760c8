"""almagre: a PySpark-native engine for schedule resolution and text-corpus preparation."""

__all__ = ["session"]
