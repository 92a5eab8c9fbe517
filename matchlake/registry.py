"""All queries of the engine and their DuckDB oracles, by name."""

from __future__ import annotations

from matchlake.plans import activity, boxes, foundations, recommendations, relational, texts, vectors  # noqa: F401
from matchlake.plans.common import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "resolve_topk"
