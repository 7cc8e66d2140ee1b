"""Operators for preparing text corpora; each module stands on its own."""
