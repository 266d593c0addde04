"""All queries of the library by survey id, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from .plans import bars, discovery, execution, features, files, hypotheses, joins, performance, refinement, rollups, slices, stats

MODULES = (bars, discovery, execution, features, files, hypotheses, joins, performance, refinement, rollups, slices, stats)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
