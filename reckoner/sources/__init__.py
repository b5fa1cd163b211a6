"""Readers and writers for raw logs, catalogues and result tables."""
