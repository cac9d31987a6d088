"""Readers and writers of rasters."""
