"""Readers of structure files and of pocket-detection outputs."""
