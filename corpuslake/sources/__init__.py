"""Readers, parsers and external clients."""
