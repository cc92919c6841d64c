"""Runnable queries over the given tables; importing this package registers them all."""

from promptloom.plans import (  # noqa: F401
    corpus,
    documents,
    evaluation,
    ordering,
    prompts,
    training_rows,
)
from promptloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
