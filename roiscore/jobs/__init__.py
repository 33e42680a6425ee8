"""Jobs over many images at once."""
