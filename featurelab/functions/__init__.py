"""Shared column primitives."""
