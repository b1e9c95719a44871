"""Relational operators, lowered to DataFrame expressions."""
