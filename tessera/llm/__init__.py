"""Operators for building language-model training data from a `documents` table."""
