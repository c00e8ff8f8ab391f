"""Whole jobs built from sources and operators."""

from . import daily, history, loaders, review

__all__ = ["daily", "history", "loaders", "review"]
