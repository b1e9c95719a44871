"""Scalar functions: patterns, JSON, sanitizers, validators."""
