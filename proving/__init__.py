"""Every operator run on the given tables, next to the same result in SQL."""

from proving import algebra, history, identity, metrics, quality, staging, streams  # noqa: F401  (they register cases)
from proving.case import CASES

__all__ = ["CASES"]
