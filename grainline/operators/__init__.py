"""grainline.operators."""
