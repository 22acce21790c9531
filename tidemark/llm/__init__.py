"""Operators and pipeline stages for training-data corpora; ``plans`` registers their queries."""
