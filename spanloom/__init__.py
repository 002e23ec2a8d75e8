"""Interval, key-join, sequence and alignment analytics as DataFrame plans."""

__version__ = "0.1.0"
