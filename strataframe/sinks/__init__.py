"""Writers for vector results and rasters."""
