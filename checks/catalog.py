"""All registered queries."""

from . import detection, layers, learning, redaction, sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
