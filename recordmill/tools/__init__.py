"""Typed tools: contracts, providers and their registry."""
