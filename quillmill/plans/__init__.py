"""Whole runs over files and tables, and the catalogue of queries."""
