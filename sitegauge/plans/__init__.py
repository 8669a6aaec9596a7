"""Runnable queries binding the operators to the test tables, with their SQL twins."""
