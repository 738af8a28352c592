"""Registered queries: each reads the supplied tables whole, next to equivalent SQL."""

from chatlake.catalog.registry import REGISTRY, oracles, queries

__all__ = ["REGISTRY", "oracles", "queries"]
