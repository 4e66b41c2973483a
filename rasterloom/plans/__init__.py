"""Registers the library's queries."""
