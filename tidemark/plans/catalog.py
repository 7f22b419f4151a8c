"""All registered queries."""

from . import catalog_ingest, catalog_text, catalog_timeline  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
