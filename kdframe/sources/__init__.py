"""Readers, writers and the fixture derivations from the driver tables."""
