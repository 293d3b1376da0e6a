"""The expression language: ``tool(selector, argument=literal) | ...``."""
