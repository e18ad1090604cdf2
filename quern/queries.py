"""All queries of the library proper."""

from quern.operators import change_queries, code_queries, compose, digests, findings, fuzzy, graph, history, inventory, orders, payloads, related, search, session_context, sessions, stores  # noqa: F401
from quern.registry import ORACLE_SQL, QUERIES  # noqa: F401
from quern.streaming import lifecycle, logs  # noqa: F401
