"""Readers, writers and feed conformers."""
