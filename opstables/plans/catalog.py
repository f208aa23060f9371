"""The operators as registered queries, with DuckDB SQL where there is one."""

from opstables.plans import dags, lists, queues, recovery, rules, series, state, streams, values  # noqa: F401
from opstables.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
