"""Whole runs: read, compute, write tables and a one-row report."""
