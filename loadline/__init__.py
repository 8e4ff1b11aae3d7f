"""Condition analytics for industrial machines as PySpark DataFrame operators."""
