"""Named queries over the test tables, each with SQL of equal results where SQL can express it."""

from . import cards, catalog, consolidate, decisions, edits, evaluation, extract, history, learning, prediction, probing, quality, receipts, retrieval, sessions, usage
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cards", "catalog", "consolidate", "decisions", "edits", "evaluation", "extract", "history", "prediction", "probing", "learning", "quality", "receipts", "retrieval", "sessions", "usage"]
