"""Operators for training corpora: scores, formats, duplicates, leaks, mixes."""
