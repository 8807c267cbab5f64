"""Readers of text, JSON and binary formats, writers, and the tables that queries derive from the driver's."""
