"""Runnable queries over the supplied tables, each with an equivalent SQL text where SQL can say it."""

from codegrove.catalog.registry import ENTRIES, Entry, load_all

__all__ = ["ENTRIES", "Entry", "load_all"]
