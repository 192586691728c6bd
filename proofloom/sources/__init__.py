"""Readers, loaders and the projection of the driver tables."""
