"""Composite plans: evidence for questions, answer-ready batches, evaluation."""
