"""Whole jobs (prepare, train, evaluate) and the registered queries with their SQL equivalents."""
