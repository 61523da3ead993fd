"""Named queries over the sample tables, each with the SQL that must give the same rows.

Raw text is made from typed columns by expressions both engines understand, so that every query
works on whole tables and grows with them.
"""

from schemagate.plans.queries import catalog, headers, intake, invoices, normalize, profiling, publish, schedule, validate
from schemagate.plans.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "headers", "intake", "invoices", "normalize", "profiling", "publish", "schedule", "validate"]
