"""Relational operators over feature vectors, score maps and labels."""
