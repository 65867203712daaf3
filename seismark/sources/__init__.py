"""Readers and writers of the tables the library works on."""

from seismark.sources.tables import read_table

__all__ = ["read_table"]
