"""grainline.plans."""
