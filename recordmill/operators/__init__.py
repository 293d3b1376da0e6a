"""Stages: the steps of a record program."""
