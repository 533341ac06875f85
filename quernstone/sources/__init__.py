"""Sources of quernstone."""
