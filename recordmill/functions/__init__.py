"""JSON types and the built-in tools."""
