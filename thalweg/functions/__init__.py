"""Constants and column functions of flow rasters."""
