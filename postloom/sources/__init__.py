"""Readers and writers for tables, pages, models and reports."""
