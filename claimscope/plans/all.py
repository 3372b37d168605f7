"""Importing this module registers every query of the library."""

from claimscope.plans import evaluation_queries, ingest_queries, job_queries, series_queries, vector_queries  # noqa: F401
from claimscope.plans.registry import QUERIES, SQL  # noqa: F401
