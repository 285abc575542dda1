"""Readers and parsers of caption files and media probes."""
