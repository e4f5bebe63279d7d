"""The registered queries and their SQL."""

from corpusmill.plans import documents, operations, records, search, services, streams  # noqa: F401
from corpusmill.plans.registry import ORACLES, QUERIES  # noqa: F401
