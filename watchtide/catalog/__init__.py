"""Every operator as a runnable query over the shared tables, with its SQL twin where one exists."""

from . import alerting, governing, impact, ingesting, logging, measuring, reporting, streaming, tracing  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
