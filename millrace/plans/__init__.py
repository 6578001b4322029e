"""Registered queries over the library's operators."""

from millrace.plans import checks, desk, events, fields, guests, intake, lineage, passports, reading, results, review, safety, texts  # noqa: F401
from millrace.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
