"""Structured Streaming forms of the resampling operators."""

from .rollup import hourly_stream

__all__ = ["hourly_stream"]
