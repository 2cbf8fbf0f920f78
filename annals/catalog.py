"""All queries of the version-history engine with their SQL counterparts."""

from __future__ import annotations

from annals.functions import dates, raw, scalars  # noqa: F401
from annals.operators import aggregates, alignment, bitmaps, blame, commands, filters, levels, logs, merging, renames, storage, trees, walks  # noqa: F401
from annals.registry import ORACLES, QUERIES
from annals.sources import tables  # noqa: F401
from annals.streaming import feeds  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
