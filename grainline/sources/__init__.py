"""grainline.sources."""
