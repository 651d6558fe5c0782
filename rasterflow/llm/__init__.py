"""Operators for preparing large text corpora; nothing outside this package imports it."""
