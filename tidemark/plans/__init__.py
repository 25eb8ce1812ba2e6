"""Query language: text to a frozen query, the query to a DataFrame."""

from tidemark.plans.explain import explain_tree
from tidemark.plans.planner import plan
from tidemark.plans.text import Query, parse

__all__ = ["Query", "explain_tree", "parse", "plan"]
