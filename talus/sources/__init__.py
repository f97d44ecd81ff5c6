"""Readers: point tiles, vectors, rasters, tile catalogues and synthetic scenes."""
