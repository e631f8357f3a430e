"""Queries by name."""

from . import registry  # isort: skip
from . import analysis, batch, qa, reports, search

__all__ = ["analysis", "batch", "qa", "registry", "reports", "search"]
