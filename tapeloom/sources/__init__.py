"""Raw files and the partitioned store."""

from .store import Store

__all__ = ["Store"]
