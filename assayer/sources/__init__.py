"""Readers for molecule files and writers for tables, splits and reports."""
