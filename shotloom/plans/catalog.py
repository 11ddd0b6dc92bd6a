"""All registered queries."""

from . import answers, assembly, cards, content, outline, streams, timeline  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
