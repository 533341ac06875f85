"""Functions of quernstone."""
