"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from corpuslake.plans import management, retrieval, stored, texts

QUERIES: dict = texts.QUERIES | retrieval.QUERIES | management.QUERIES | stored.QUERIES
ORACLES: dict[str, str] = texts.ORACLES | retrieval.ORACLES | management.ORACLES | stored.ORACLES
