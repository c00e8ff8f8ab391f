"""Structured Streaming jobs."""

from . import landing

__all__ = ["landing"]
