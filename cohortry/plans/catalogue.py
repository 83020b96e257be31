"""Imports every module that registers queries."""

from cohortry.plans import ctes, flagship, ingest, filters, joins, aggregates, windows_sets, scalars, draws, evaluation, graphs, audits, models, streams  # noqa: F401
from cohortry.plans.registry import QUERIES, oracle_sql  # noqa: F401
