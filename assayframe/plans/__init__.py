"""Queries over the test tables, with the SQL that checks them."""

from . import documents, events, evidence, policies, publishing, sources, statements, validation, verification, workflows
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "documents", "events", "evidence", "policies", "publishing", "sources", "statements", "validation", "verification", "workflows"]
