"""Argentum: a media-library analytics engine expressed as Spark plans."""

__version__ = "0.1.0"
