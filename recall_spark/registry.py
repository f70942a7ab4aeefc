"""Queries of the library by name, and their equivalents in SQL."""

from __future__ import annotations

import recall_spark.plans.compaction  # noqa: F401  (registers its queries)
import recall_spark.plans.context  # noqa: F401  (registers its queries)
import recall_spark.plans.transcript  # noqa: F401  (registers its queries)
import recall_spark.plans.streams  # noqa: F401  (registers its queries)
import recall_spark.plans.vectors  # noqa: F401  (registers its queries)
import recall_spark.plans.payloads  # noqa: F401  (registers its queries)
import recall_spark.plans.store  # noqa: F401  (registers its queries)
from recall_spark.plans.queries import ORACLES, QUERIES

FLAGSHIP = "x3_search_summaries"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
