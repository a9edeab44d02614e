"""Lodestrata: search and corpus analytics over repositories of code, on PySpark."""
