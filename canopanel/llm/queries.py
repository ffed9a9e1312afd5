"""The registered queries of this subpackage; importing this module registers them all."""

from __future__ import annotations

from canopanel.llm import queries_native, queries_ordered, queries_python  # noqa: F401  (register their queries)
from canopanel.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
