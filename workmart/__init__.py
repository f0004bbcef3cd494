"""Work-activity analytics on Spark: landed tables -> classes -> marts -> metrics."""

from workmart.session import build_session

__all__ = ["build_session"]
