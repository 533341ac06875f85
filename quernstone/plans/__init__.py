"""Plans of quernstone."""
