"""Writers: point tiles, rasters, vectors, KMZ and reports."""
