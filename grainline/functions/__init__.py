"""grainline.functions."""
