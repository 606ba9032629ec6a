"""The library's functions."""
