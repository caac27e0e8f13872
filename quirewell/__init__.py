"""quirewell: a PySpark-native analytics engine for nested document collections."""

__all__ = ["session"]
