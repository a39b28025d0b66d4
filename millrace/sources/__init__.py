"""Parsers of the line feeds, and feeds derived from the given tables."""
