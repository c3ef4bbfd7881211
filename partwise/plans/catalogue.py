"""All queries of the catalogue engine: importing this module loads every plan into the registry."""

from __future__ import annotations

from partwise.plans import (  # noqa: F401
    aggregates, articles, composed, dedup, extraction, extras, identity, lifecycle, matching, metrics, normalize, quality, relational, scans, search, sinks, symbols, text, windows,
)
from partwise.plans.registry import ALIASES, FLAGSHIP, ORACLE, QUERIES  # noqa: F401
