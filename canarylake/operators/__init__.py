"""The library's operators."""
