"""Readers, payload flattening, writers and fixture views."""
