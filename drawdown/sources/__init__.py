"""Readers, role bindings and writers."""
