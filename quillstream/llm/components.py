"""Connected components of links: those of the library, whose contraction spreads a node with very many links."""

from quillstream.operators.graph import components, least_reachable as local_components

__all__ = ["components", "local_components"]
