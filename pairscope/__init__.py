"""Corpus-scale comparison of predicted base-pair sets with known structures, as Spark jobs."""

from pairscope.session import prepare

__all__ = ["prepare"]
