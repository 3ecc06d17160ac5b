"""Predicates, index choice and explain output: what is decided before Spark runs."""
