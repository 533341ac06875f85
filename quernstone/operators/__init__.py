"""Operators of quernstone."""
