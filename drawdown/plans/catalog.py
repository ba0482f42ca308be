"""Importing this module registers every query."""
from __future__ import annotations

from . import aggregates, business, calibration, decline, forecast, geometry, hygiene, learning, series, statutes, text, unit, uploads  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
