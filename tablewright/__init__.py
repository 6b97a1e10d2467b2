"""Tablewright: read-only analytics over mixed sources, planned and run by Spark."""
