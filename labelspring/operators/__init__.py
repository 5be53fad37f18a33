"""Relational operators: labels, splits, ranks, counts, evaluation."""
