"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from . import registry, text_queries, table_queries, book_queries, structure_queries, compare_queries, diff_queries, source_queries  # noqa: F401, I001
